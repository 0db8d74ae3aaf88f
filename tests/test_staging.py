"""One rule per made-up loan: typing, labels, exclusions, spread and checks."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions import typing as T
from loanloom.operators import features, quality, staging

BASE = dict(credit_score="720", first_payment_date="201603", first_time_homebuyer="N", maturity_date="204602", msa="", mi_pct="0", n_units="1",
            occupancy="P", cltv="80", dti="35", orig_upb="200000", ltv="80", int_rate="3.5", channel="R", ppm_flag="N", amort_type="FRM", state="CA",
            property_type="SF", zip3="90000", purpose="P", orig_term="360", n_borrowers="2", seller_name="X", super_conforming="", relief_refi="N",
            io_indicator="N", program_indicator="9")


def key(i):
    return f"F16Q10000{i:03d}"


def origination(spark, changes):
    rows = [{**dict.fromkeys(S.ORIGINATION_COLUMNS), **BASE, "loan_seq": key(i), **c} for i, c in changes.items()]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in S.ORIGINATION_COLUMNS))


def performance(spark, histories):
    rows = []
    for i, (last, events) in histories.items():
        for age in range(last + 1):
            rows.append({**dict.fromkeys(S.PERFORMANCE_COLUMNS), "loan_seq": key(i), "loan_age": str(age), "delinq_status": "00", **events.get(age, {})})
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in S.PERFORMANCE_COLUMNS))


HISTORIES = {
    1: (30, {}), 2: (30, {10: {"delinq_status": "03"}}), 3: (30, {10: {"delinq_status": "03", "borrower_assist_code": "F"}}),
    4: (20, {20: {"zero_balance_code": "03"}}), 5: (12, {12: {"zero_balance_code": "01"}}), 6: (9, {}),
    7: (30, {}), 8: (30, {}), 9: (30, {}),
}
CHANGES = {i: {} for i in range(1, 10)} | {7: {"relief_refi": "Y", "dti": "999"}, 8: {"first_payment_date": "201903"},
                                          9: {"dti": "999", "credit_score": "9999", "n_units": "99"}}


@pytest.fixture(scope="module")
def staged(spark):
    return staging.stage_origination(origination(spark, CHANGES)).cache(), staging.label_per_loan(performance(spark, HISTORIES)).cache()


def test_labels(staged):
    got = {r["loan_seq"]: (r["observable_24m"], r["default_24m"], r["default_24m_all_late"], r["default_24m_loss_only"]) for r in staged[1].collect()}
    assert got[key(1)] == (True, 0, 0, 0)
    assert got[key(2)] == (True, 1, 1, 0)
    assert got[key(3)] == (True, 0, 1, 0)
    assert got[key(4)] == (True, 1, 1, 1)
    assert got[key(5)] == (True, 0, 0, 0)
    assert got[key(6)] == (False, None, None, None)


def test_typing_and_flags(staged):
    rows = {r["loan_seq"]: r for r in staged[0].collect()}
    nine, eight = rows[key(9)], rows[key(8)]
    assert (nine["dti"], nine["credit_score"], nine["n_units"]) == (None, None, None)
    assert rows[key(7)]["relief_refi"] and rows[key(7)]["dti"] is None
    assert eight["is_seasoned_or_modified"] and not nine["is_seasoned_or_modified"]
    assert rows[key(1)]["vintage_year"] == 2016 and rows[key(1)]["vintage_quarter"] == 1
    assert rows[key(1)]["first_payment_date"] == date(2016, 3, 1) and rows[key(1)]["months_after_vintage"] == 2
    assert rows[key(1)]["msa"] is None and rows[key(1)]["super_conforming"] is None


def test_waterfall_accounts_for_every_loan(staged):
    r = features.exclusion_waterfall(features.join_labels(*staged)).first()
    assert (r["start"], r["removed_relief_refi"], r["removed_seasoned_or_modified"], r["removed_not_observable"], r["kept"], r["unaccounted"]) == (9, 1, 1, 1, 6, 0)


def test_month_start(spark):
    df = spark.createDataFrame([("201612",), ("201613",), ("",), (None,), ("20161",)], "m string")
    assert [r[0] for r in df.select(T.month_start(F.col("m"))).collect()] == [date(2016, 12, 1), None, None, None, None]


def test_rate_spread_per_term_class(spark):
    rows = [("a", 2016, 1, 180, 3.0), ("b", 2016, 1, 180, 3.2), ("c", 2016, 1, 360, 4.0), ("d", 2016, 1, 360, 4.4), ("e", 2016, 1, None, 5.0)]
    df = spark.createDataFrame(rows, "loan_seq string, vintage_year int, vintage_quarter int, orig_term int, int_rate double")
    for build in (features.rate_spread, features.rate_spread_window):
        got = {r["loan_seq"]: round(r["rate_spread"], 9) for r in build(df).collect()}
        assert got == {"a": -0.1, "b": 0.1, "c": -0.2, "d": 0.2, "e": 0.0}


def test_vintage_pivot_and_nearest(spark):
    df = spark.createDataFrame([("F99Q4x", 1997), ("F08Q1x", 1994)], "k string, y int")
    rows = df.select(T.vintage_year(F.col("k")), T.nearest_reference(F.col("y"), [1995, 1996, 1998])).collect()
    assert [tuple(r) for r in rows] == [(1999, 1996), (2008, 1995)]


def test_checks_pass_and_fail(staged, spark):
    orig, label = staged
    ok = {r["check"]: r["passed"] for r in quality.dq_staging_checks(orig, label, max_missing=0.5, max_rate=0.9).collect()}
    assert all(ok.values()) and {"orig_key_unique", "score_missing_share", "no_orphans"} <= set(ok)
    doubled = orig.unionByName(orig.filter(F.col("loan_seq") == key(1)))
    bad = {r["check"]: r["passed"] for r in quality.dq_staging_checks(doubled, label, max_missing=0.01, max_rate=0.9).collect()}
    assert not bad["orig_key_unique"] and not bad["score_missing_share"]
    with pytest.raises(quality.DataCheckError, match="orig_key_unique"):
        quality.dq_blocking_gate(quality.dq_staging_checks(doubled, label))


def test_orphans_are_found(staged):
    orig, label = staged
    got = {r["check"]: r["value"] for r in quality.dq_staging_checks(orig.filter(F.col("loan_seq") != key(2)), label).collect()}
    assert got["no_orphans"] == 1
