"""Resampling by hashed weights against the same weights laid out in full, and against plain resampling of rows."""

import numpy as np
import pytest

from loanloom.operators import bootstrap


def loans(n=900, seed=5):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.15).astype(int)
    a = np.round(np.clip(0.15 + 0.1 * y + 0.1 * rng.standard_normal(n), 0.01, 0.99), 2)  # many ties
    b = np.clip(0.15 + 0.05 * y + 0.1 * rng.standard_normal(n), 0.01, 0.99)
    b[: n // 3] = 0.2  # one value for a third of all rows
    a[-150:], b[-150:], y[-150:] = 0.3, 0.4, 0  # equal rows
    return [(int(k), 2000 + int(k) % 2, int(t), float(p), float(q)) for k, (t, p, q) in enumerate(zip(y, a, b))]


SCHEMA = "id int, year int, y int, a double, b double"


def measures(x, y, w):
    """Weighted Gini, KS, Brier and predicted/observed by laying the values in order."""
    values = np.unique(x)
    good, bad = (np.array([w[(x == v) & (y == k)].sum() for v in values]) for k in (0, 1))
    g, b = good.sum(), bad.sum()
    before_g, before_b = np.cumsum(good) - good, np.cumsum(bad) - bad
    gini = 2 * (bad * (before_g + good / 2)).sum() / (g * b) - 1
    return gini, max((before_g / g - before_b / b).max(), 0), (w * (x - y) ** 2).sum() / w.sum(), (w * x).sum() / b


@pytest.mark.parametrize(("range_cells", "chunk", "drawn"), [(20_000, 250, 1 << 20), (40, 7, 64)])
def test_measures_equal_the_weights_laid_out_in_full(spark, monkeypatch, range_cells, chunk, drawn):
    monkeypatch.setattr(bootstrap, "CHUNK", chunk)
    monkeypatch.setattr(bootstrap, "DRAWN", drawn)
    df = spark.createDataFrame(loans() + [(-1, 2000, None, 0.5, 0.5), (-2, 2000, 1, None, 0.5)], SCHEMA).repartition(3)
    got = {(r.year, r.resample, r.arm): r[3:] for r in bootstrap.paired_bootstrap(df, "y", ["a", "b"], 20, by=["year"], range_cells=range_cells).collect()}
    assert len(got) == 2 * 20 * 2
    hashed = df.dropna().groupBy("year", "y", "a", "b").count()
    hashed = hashed.selectExpr("*", "xxhash64(42, to_json(struct(year)), y, a, b) AS h").toPandas()
    for year, part in hashed.groupby("year"):
        w = bootstrap.poisson_weights(part["h"].to_numpy(), part["count"].to_numpy(), 0, 20)
        for arm in "ab":
            for r in range(20):
                expected = measures(part[arm].to_numpy(), part["y"].to_numpy(), w[:, r])
                assert got[year, r + 1, arm] == pytest.approx(expected, abs=1e-12)


def test_weights_follow_the_poisson_law():
    h = np.random.default_rng(1).integers(-(2**63), 2**63, 4000)
    for n in (1, 2, 7, 400, 100_000):
        w = bootstrap.poisson_weights(h, np.full(len(h), n), 3, 103)
        assert abs(w.mean() / n - 1) < 4 / np.sqrt(n * w.size) and abs(w.var() / n - 1) < 0.02
    one = bootstrap.poisson_weights(h, np.ones(len(h), int), 0, 50)
    assert [np.mean(one == k) for k in range(4)] == pytest.approx([np.exp(-1), np.exp(-1), np.exp(-1) / 2, np.exp(-1) / 6], abs=0.004)
    assert (bootstrap.poisson_weights(h, np.ones(len(h), int), 20, 50) == one[:, 20:]).all()
    assert abs(np.corrcoef(one[:, 3], one[:, 4])[0, 1]) < 0.05 and abs(np.corrcoef(one[0], one[1])[0, 1]) < 0.5


def test_intervals_agree_with_resampled_rows(spark):
    rows = [r for r in loans(1500, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    table = bootstrap.interval_table(bootstrap.paired_bootstrap(df, "y", ["a", "b"], 1000), by=["arm"])
    got = {(r.arm, r.measure): (r.low, r.high) for r in table.collect()}
    rng = np.random.default_rng(2)
    y, arms = np.array([r[2] for r in rows]), {"a": np.array([r[3] for r in rows]), "b": np.array([r[4] for r in rows])}
    names = ("gini", "ks", "brier", "pred_over_obs")
    for arm, x in arms.items():
        draws = np.array([measures(x, y, rng.multinomial(len(rows), np.full(len(rows), 1 / len(rows)))) for _ in range(600)])
        low, high = np.percentile(draws, [2.5, 97.5], axis=0)
        for i, m in enumerate(names):
            width = high[i] - low[i]
            assert abs(got[arm, m][0] - low[i]) < 0.15 * width and abs(got[arm, m][1] - high[i]) < 0.15 * width, (arm, m)


def test_no_exchange_holds_cells_times_resamples(spark):
    df = spark.createDataFrame(loans(), SCHEMA)
    found = bootstrap.paired_bootstrap(df, "y", ["a", "b"], 1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and not any("resample" in line for line in exchanged if "grp" not in line)
    assert bootstrap.paired_bootstrap(df.limit(0), "y", ["a", "b"], 5).collect() == []
