"""Hand examples and brute-force comparisons on small inputs with ties."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions import bands, hashing, stats
from loanloom.operators import binning, bootstrap, challengers, fairness, metrics, monitoring, money, parity, ranks, scorecard, scoring, stability


@pytest.fixture(scope="module")
def tied(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        p = 0.3 if i % 3 == 0 else round(rng.random(), 2)  # a third of all rows share one score
        rows.append((f"k{i}", p, int(rng.random() < 0.1 + 0.5 * p)))
    return spark.createDataFrame(rows, "key string, p double, y int").cache(), pd.DataFrame(rows, columns=["key", "p", "y"])


def brute(pdf):
    y, p = pdf.y.to_numpy(), pdf.p.to_numpy()
    bad, good = p[y == 1], p[y == 0]
    auc = ((bad[:, None] > good[None, :]).sum() + 0.5 * (bad[:, None] == good[None, :]).sum()) / (len(bad) * len(good))
    ks, ap, last = 0.0, 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tpr, fpr = (bad >= t).mean(), (good >= t).mean()
        ks = max(ks, tpr - fpr)
        ap += (tpr - last) * (y[p >= t].mean())
        last = tpr
    return auc, ks, ap, ((p - y) ** 2).mean()


def test_metrics_equal_brute_force(tied):
    df, pdf = tied
    r = metrics.evaluate(df, "y", "p").first()
    auc, ks, ap, brier = brute(pdf)
    assert r["auc"] == pytest.approx(auc, abs=1e-12) and r["gini"] == pytest.approx(2 * auc - 1, abs=1e-12)
    assert r["ks"] == pytest.approx(ks, abs=1e-12) and r["pr_auc"] == pytest.approx(ap, abs=1e-12) and r["brier"] == pytest.approx(brier, abs=1e-12)


@pytest.mark.parametrize("bins", [3, 10])
def test_equal_bins_split_a_hot_score_exactly(tied, spark, bins):
    df, pdf = tied
    order = {r["key"]: r["u"] for r in df.select("key", hashing.uniform32(F.col("key"), "tie").alias("u")).collect()}
    pdf = pdf.assign(u=pdf.key.map(order)).sort_values(["p", "u", "key"]).reset_index(drop=True)
    pdf["bin"] = pd.qcut(np.arange(1, len(pdf) + 1), bins, labels=False)
    got = {r["key"]: r["bin"] for r in ranks.equal_size_bins(df, "p", "key", bins).collect()}
    assert got == dict(zip(pdf.key, pdf.bin))


def test_quantile_edges(tied):
    df, pdf = tied
    cells = ranks.running_before(ranks.score_cells(df, "p", "y"), ["n"])
    shares = [0.0, 0.1, 0.333, 0.5, 0.975, 1.0]
    assert metrics.quantile_edges(cells, shares).first()["edges"] == pytest.approx(list(np.quantile(pdf.p, shares)))


def test_hash_cut_takes_the_exact_number(tied):
    df, _ = tied
    for size in (0, 1, 137, 900, 2000):
        inside, rest = monitoring.sample_and_rest(df, size, "key", "s")
        assert inside.count() == min(size, 900) and rest.count() == 900 - min(size, 900)


def test_stratified_split_keeps_the_rate(tied):
    df, pdf = tied
    rest, held = challengers.stratified_split(df, "y", "key", 0.2, "z")
    counts = {r["y"]: r["count"] for r in held.groupBy("y").count().collect()}
    assert counts == {v: round(0.2 * (pdf.y == v).sum()) for v in (0, 1)}
    assert held.join(rest, "key").count() == 0


def test_spearman(tied):
    df, pdf = tied
    b = pdf.p * (pdf.y - 0.4)
    df2 = df.withColumn("b", F.col("p") * (F.col("y") - 0.4))
    assert metrics.spearman(df2, "p", "b").first()[0] == pytest.approx(pdf.p.rank().corr(b.rank()), abs=1e-9)


def test_band_rule(spark):
    spec = {"edges": [1.0, 2.0]}
    df = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (2.0,), (9.0,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(bands.band_index("x", spec)).collect()] == [0, 0, 1, 1, 2, 3, 3]
    assert bands.band_labels(spec) == ["<= 1", "(1, 2]", "> 2", "missing"] and bands.band_labels({"edges": []}) == ["all", "missing"]
    cat = spark.createDataFrame([("a",), ("z",), (None,)], "c string").select(bands.band_index("c", {"categories": ["a", "b"]}))
    assert [r[0] for r in cat.collect()] == [0, 2, 3]


def test_adopted_model_and_golden_loan(spark):
    model = scoring.adopted_model()
    assert model["model_id"] == "b3069001d62e" and scoring.model_problems(model) == []
    one = spark.range(1).select(*[F.lit(v).alias(f) for f, v in S.GOLDEN_LOAN.items()])
    r = scoring.explain_batch(model, one).first()
    assert r["score"] == pytest.approx(S.GOLDEN_SCORE, abs=S.GOLDEN_TOLERANCE)
    assert sum(r["points"].values()) == pytest.approx(r["score"])
    lost = [x["points_lost"] for x in r["reasons"]]
    assert lost == sorted(lost, reverse=True) and min(lost) >= 5 and len(lost) == 4


def test_model_damage_is_named():
    model = scoring.adopted_model()
    assert scoring.model_problems({k: v for k, v in model.items() if k != "scaling"}) == ["missing key: scaling"]
    bad = {**model, "features": {**model["features"], "dti": {**model["features"]["dti"], "edges": [3.0, 2.0, 1.0, 4.0, 5.0]}}}
    assert any("strictly increasing" in p for p in scoring.model_problems(bad))


def best_first(x, y, leaves, least):
    """Plain best-first tree on one feature."""
    def gini(v):
        return 2 * v.sum() * (len(v) - v.sum()) / len(v)

    def split(mask):
        best = None
        xs = np.unique(x[mask])
        for a, b in zip(xs, xs[1:]):
            left, right = mask & (x <= a), mask & (x > a)
            if left.sum() < least or right.sum() < least or y[mask].min() == y[mask].max():
                continue
            gain = gini(y[mask]) - gini(y[left]) - gini(y[right])
            if best is None or gain > best[0] + 1e-12:
                best = (gain, (a + b) / 2, left, right)
        return best

    open_, cuts = [split(np.ones(len(x), bool))], []
    while len(cuts) < leaves - 1 and any(open_):
        open_ = [o for o in open_ if o]
        top = max(open_, key=lambda o: o[0])
        open_.remove(top)
        cuts.append(top[1])
        open_ += [split(top[2]), split(top[3])]
    return sorted(cuts)


def test_supervised_edges_equal_a_plain_tree(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=1500), 1)
    z = rng.integers(0, 40, 1500).astype(float)
    y = (rng.random(1500) < np.where(x > 0.4, 0.35, 0.1) + np.where(z > 30, 0.2, 0)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "z": z, "y": y}))
    edges = binning.supervised_edges(binning.value_cells(df, ["x", "z"], "y"), {"x": 1500, "z": 1500})
    for name, values in (("x", x), ("z", z)):
        assert edges[name] == pytest.approx(best_first(values, y, 6, max(30, int(0.05 * 1500))))


def test_woe_empty_band_is_neutral(spark):
    df = spark.createDataFrame([(1.0, 0)] * 40 + [(1.0, 1)] * 10 + [(3.0, 0)] * 45 + [(3.0, 1)] * 5, "x double, y int")
    rows = {r["band"]: r for r in binning.woe_table(df, {"x": {"edges": [2.0]}}, "y").collect()}
    assert rows[2]["n"] == 0 and rows[2]["woe"] == 0.0
    expected = math.log(((40 + .5) / (85 + 1.5)) / ((10 + .5) / (15 + 1.5)))
    assert rows[0]["woe"] == pytest.approx(expected)


def test_scorecard_points_add_up_and_double_odds(spark):
    rng = np.random.default_rng(9)
    score = rng.integers(500, 850, 3000).astype(float)
    dti = rng.integers(0, 60, 3000).astype(float)
    y = (rng.random(3000) < 1 / (1 + np.exp((score - 620) / 60 - dti / 40))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"credit_score": score, "dti": dti, "y": y}))
    card = scorecard.fit_scorecard(df, "y", ["credit_score", "dti"], [])
    assert card.selected == ["credit_score", "dti"] and card.sign_violations() == []
    record = card.export("t")
    out = card.predict_pd(card.score_points(df, "score")).withColumn("summed", scoring.score_column(record)).withColumn(
        "pd2", scoring.pd_column(record, F.col("summed")))
    worst = out.agg(F.max(F.abs(F.col("score") - F.col("summed"))), F.max(F.abs(F.col("pd") - F.col("pd2")))).first()
    assert worst[0] < 1e-6 and worst[1] < 1e-9
    factor, offset = scorecard.scaling_factors()
    assert offset + factor * math.log(50) == pytest.approx(600) and factor * math.log(2) == pytest.approx(20)


def test_cutoff_hand_example(spark):
    df = spark.createDataFrame([(0, 100.0, 0.1), (0, 200.0, 0.1), (1, 100.0, 0.1), (0, 100.0, 0.9)], "y int, ead double, pd double")
    assert money.realised_profit(df, F.col("pd") < 0.5, 0.02, 0.10).first()["profit"] == pytest.approx(-4.0)


def test_lgd_hand_example(spark):
    loans = spark.createDataFrame([("A", 2008, 200000.0, 1), ("B", 2008, 100000.0, 1), ("C", 2008, 300000.0, 1), ("D", 2008, 150000.0, 0), ("E", 2008, 100000.0, 1)],
                                  "loan_seq string, vintage_year int, orig_upb double, default_24m int")
    perf = spark.createDataFrame([("A", "03", "50000", "100000"), ("B", "09", "-10000", "60000"), ("E", "02", None, "80000"), ("C", None, None, None), ("D", None, None, None)],
                                 "loan_seq string, zero_balance_code string, actual_loss string, zero_balance_removal_upb string")
    r = money.lgd_summary(loans, perf).first()
    assert (r["lgd_loss_events"], r["loss_per_flag"], r["share_no_loss_or_gain"]) == (0.25, round(40000 / 700000, 4), 0.5)
    assert (r["flagged_defaults"], r["loss_event_loans"], r["loss_event_with_amount"]) == (4, 3, 2)


def test_profit_curve_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"pd": np.round(rng.random(400) ** 2, 3), "ead": rng.integers(1, 9, 400) * 100.0})
    pdf["y"] = (rng.random(400) < pdf.pd).astype(int)
    got = money.profit_curve(spark.createDataFrame(pdf), 0.3, 0.5).orderBy("threshold").collect()
    levels = np.unique(np.quantile(pdf.pd, np.linspace(0.5, 1, 101)))
    assert [r["threshold"] for r in got] == pytest.approx(list(levels))
    for r, t in zip(got, levels):
        ok = pdf.pd <= t
        assert r["approval_rate"] == pytest.approx(ok.mean())
        assert r["profit"] == pytest.approx((np.where(pdf.y == 0, 0.3 * pdf.ead, -0.5 * pdf.ead) * ok).sum())


def test_psi_of_identical_data_is_zero(spark):
    ref = spark.createDataFrame([("score", 1, 10), ("score", 2, 30)], "monitor string, band bigint, n bigint")
    cur = spark.createDataFrame([("same", "score", 1, 20), ("same", "score", 2, 60), ("new", "score", 7, 5)], "b string, monitor string, band bigint, n bigint")
    got = {r["b"]: r["psi"] for r in monitoring.psi(monitoring.drift_universe(ref, cur, "b"), ["b", "monitor"]).collect()}
    assert got["same"] == pytest.approx(0.0)
    f = 1e-4
    expected = sum((c - r) * math.log(c / r) for c, r in ((f, 0.25), (f, 0.75), (1.0, f)))
    assert got["new"] == pytest.approx(expected)


def test_solve_shift_hits_its_target_and_keeps_the_ranking(spark, tied):
    df, _ = tied
    cells = ranks.score_cells(df, "p", "y").withColumn("grp", F.lit("g")).filter("x > 0 AND x < 1")
    delta = monitoring.solve_shifts(cells, {"g": 0.07})["g"]
    q = stats.logit_shift(F.col("x"), delta)
    assert cells.agg(F.sum(F.col("n") * q) / F.sum("n")).first()[0] == pytest.approx(0.07, abs=1e-10)
    before = metrics.evaluate_cells(cells.select("x", "n", "bad")).first()["gini"]
    after = metrics.evaluate_cells(cells.select(q.alias("x"), "n", "bad")).first()["gini"]
    assert before == pytest.approx(after, abs=1e-9)
    with pytest.raises(ValueError):
        monitoring.solve_shifts(cells, {"g": 1.0})


def test_flip_count_rounds_half_to_even(spark):
    df = spark.createDataFrame([(f"k{i}", 1 if i < 10 else 0) for i in range(40)], "key string, y int")
    assert monitoring.perturb_default_rate(df, 1.25, "key", "s").agg(F.sum("y")).first()[0] == 12  # 12.5 -> 12
    assert monitoring.perturb_default_rate(df, 100.0, "key", "s").agg(F.sum("y")).first()[0] == 40


def test_bootstrap_is_paired_and_centred(tied):
    df, pdf = tied
    both = df.withColumn("a", F.col("p")).withColumn("b", F.col("p"))
    reps = bootstrap.paired_bootstrap(both, "y", ["a", "b"], 60).cache()

    g = {(r["resample"], r["arm"]): r["gini"] for r in reps.collect()}
    assert all(g[i, "a"] == pytest.approx(g[i, "b"]) for i in range(1, 61))
    mean = np.mean([g[i, "a"] for i in range(1, 61)])
    assert mean == pytest.approx(2 * brute(pdf)[0] - 1, abs=0.03)
    assert np.std([g[i, "a"] for i in range(1, 61)]) > 0.01


def test_smote_balances_between_neighbours(spark):
    rng = np.random.default_rng(8)
    rows = [(f"k{i}", int(i < 13), float(rng.normal()), float(rng.normal())) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, y int, a double, b double")
    out = challengers.smote_oversample(df, "y", "key", ["a", "b"]).toPandas()
    assert (out.y == 1).sum() == (out.y == 0).sum() == 47 and out.synthetic.sum() == 34
    bad = out[(out.y == 1) & ~out.synthetic]
    new = out[out.synthetic]
    assert new.a.between(bad.a.min(), bad.a.max()).all() and new.b.between(bad.b.min(), bad.b.max()).all()


def test_noise_floor_keeps_the_totals():
    n, bad = np.array([50, 30, 0, 20]), np.array([5, 10, 0, 1])
    draw = stability._shuffled(n, bad, np.random.default_rng(1))
    assert draw.sum() == bad.sum() and (draw <= n).all()


def test_fairness_flags(spark):
    rows = [("A", 0.01, 0)] * 600 + [("B", 0.5, int(i % 2 == 0)) for i in range(600)] + [(None, 0.01, 0)] * 10
    df = spark.createDataFrame(rows, "channel string, pd double, y int")
    got = {r["group"]: r for r in fairness.fairness_slice(df, 0.1, ["channel"]).collect()}
    assert set(got) == {"A", "B"}  # the missing group is too small
    assert got["B"]["flag_approval"] and not got["A"]["flag_approval"] and not got["B"]["flag_calibration"]


def test_differences(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None)], "k int, v string")
    assert {tuple(r) for r in parity.symmetric_difference(a, b).collect()} == {("left", 2, "y"), ("right", 2, "z")}
    assert {tuple(r) for r in parity.multiset_difference(a, b).collect()} == {("left", 1, "1", "x"), ("left", 1, "2", "y"), ("right", 1, "2", "z")}


def test_rank_measures_read_their_table_once_and_sums_need_no_order(spark, tmp_path):
    path = str(tmp_path / "scored")
    spark.range(500).selectExpr("cast(id % 7 as int) as v", "cast(id % 3 = 0 as int) as y", "(id % 50) / 50D as p").write.parquet(path)
    df = spark.read.parquet(path)
    plan = lambda out: out._jdf.queryExecution().executedPlan().toString()
    assert path not in plan(metrics.evaluate(df, "y", "p", ["v"]))  # only the written cells
    sums = plan(metrics.evaluate(df, "y", "p", ["v"], ["brier", "default_rate"]))
    assert "Window" not in sums and sums.count("FileScan") == 1
    whole = {r["v"]: r["brier"] for r in metrics.evaluate(df, "y", "p", ["v"]).collect()}
    assert {r["v"]: r["brier"] for r in metrics.evaluate(df, "y", "p", ["v"], ["brier"]).collect()} == pytest.approx(whole)
