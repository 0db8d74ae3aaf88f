"""Quantiles by narrowing against sorted values."""

import numpy as np
import pytest

from loanloom.operators import features, selection


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    out = [("a", float(x)) for x in rng.normal(size=700)] + [("b", float(x)) for x in rng.integers(0, 5, 300)]
    out += [("c", 1.5)] * 400 + [("c", float(x)) for x in rng.random(200)] + [(None, 2.0), (None, 4.0), (None, 5.0), ("d", 7.0)]
    return out + [("a", None), ("a", float("nan")), ("e", None), ("f", -0.0), ("f", 0.0)]


SHARES = [0.0, 0.025, 0.3, 0.5, 0.975, 1.0]


@pytest.mark.parametrize("limit", [100_000, 20, 1])
def test_quantiles_equal_sorted_values(spark, rows, limit, monkeypatch):
    monkeypatch.setattr(selection, "RANGES", 8)
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r["k"]: list(r["quantiles"]) for r in selection.group_quantiles(df, "v", ["k"], SHARES, limit).collect()}
    expected = {}
    for k in {k for k, _ in rows}:
        v = [x for key, x in rows if key == k and x is not None and x == x]
        if v:
            expected[k] = np.quantile(v, SHARES).tolist()
    assert set(got) == set(expected)
    assert all(got[k] == pytest.approx(expected[k], abs=1e-12) for k in got)


def test_whole_table_and_empty_table(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    v = [x for _, x in rows if x is not None and x == x]
    assert selection.group_quantiles(df, "v", [], [0.5, 0.9], 50).first()["quantiles"] == pytest.approx(np.quantile(v, [0.5, 0.9]).tolist())
    assert selection.group_quantiles(df.limit(0), "v", ["k"], [0.5]).collect() == []


def test_group_medians_hold_no_group(spark, rows):
    df = spark.createDataFrame([(k, 1, v) for k, v in rows if v == v], "k string, j int, v double")
    found = features.group_medians(df, "v", ("k", "j"), "m")
    got = {r["k"]: r["m"] for r in found.collect()}
    assert got == pytest.approx({k: float(np.median([x for key, x in rows if key == k and x is not None and x == x])) for k in ("a", "b", "c", "d", None, "f")})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "ObjectHashAggregate" not in plan
