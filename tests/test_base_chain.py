"""Joins of the base chain on tables whose compressed files look small."""

import re

import pytest

from loanloom.operators import features as feat
from loanloom.plans import loans


def joins(df):
    return re.findall(r"(\w+Join) \[(\w+)#", df._jdf.queryExecution().executedPlan().toString())


def test_tables_that_grow_are_not_broadcast(spark, sf):
    assert ("SortMergeJoin", "o_custkey") in joins(loans.origination_view(spark, sf))
    assert ("SortMergeJoin", "l_orderkey") in joins(loans.performance_view(spark, sf))


def test_raw_layers_are_not_read_for_the_joined_table(spark, sf):
    plan = loans.labelled(spark, sf).select("loan_seq", "default_24m")._jdf.queryExecution().executedPlan().toString()
    assert "staged-" not in plan and "l_extendedprice" not in plan and "l_shipdate" not in plan


def test_medians_are_broadcast_so_that_loans_are_not_shuffled(spark):
    rows = [(2000, 1, 360, 4.0), (2000, 1, 360, 4.4), (2000, None, 360, 5.0), (None, None, None, 6.0)]
    kept = spark.createDataFrame(rows, "vintage_year int, vintage_quarter int, orig_term int, int_rate double")
    spread = feat.rate_spread(kept)
    assert "SortMergeJoin" not in spread._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["rate_spread"] for r in spread.collect()) == pytest.approx([-0.2, 0.0, 0.0, 0.2])
