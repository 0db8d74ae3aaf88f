"""Registered queries against their SQL on the smallest tables."""

import pytest
from oracle_check import compare, duck

from loanloom.plans import ORACLES, QUERIES

SLOW = {"stratified_kfold", "leave_one_vintage_out", "predict_pd", "imbalance_ablation", "fit_boosted_trees", "monitoring_self_check"}
SAMPLE = ["split_summary", "exclusion_waterfall", "stage_origination", "label_per_loan", "rate_spread", "scan_zip_members", "dq_staging_checks", "evaluate",
          "evaluate_by_vintage", "calibration_table", "profit_curve", "fairness_report", "drift_by_vintage", "drift_drill_grid", "lgd_summary",
          "symmetric_difference", "table_parity", "woe_table", "signed_gini_by_vintage", "explain_batch", "stream_score", "stream_drift_window",
          "latency_summary", "memo_number_audit", "document_text_audit", "perturb_default_rate", "sensitivity_grid"]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_entry_and_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


def test_known_split_counts(spark):
    rows = {r["split"]: (r["loans"], r["defaults_b"], r["defaults_a"]) for r in QUERIES["simple_slice"](spark, "/root/testdata/sf0.01").collect()}
    assert rows == {"train": (4802, 611, 756), "calibration": (821, 98, 122), "validation": (1250, 170, 223), "test_in_time": (1186, 157, 193),
                    "test_oot_1": (2070, 266, 325), "test_oot_2": (3265, 404, 506)}
