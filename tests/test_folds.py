"""Left-out vintages from shared statistics against cards refitted one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.operators import binning, folds, metrics, scorecard, scoring

SETS = {"both": (["a", "b"], ["c"]), "one": (["b"], [])}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(12)
    n = 3000
    v = rng.integers(2001, 2003, n)
    a, b = rng.normal(size=(2, n)).round(2)
    c = rng.choice(["x", "y", "z", "rare"], n, p=[0.5, 0.3, 0.195, 0.005])
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.9 * a - 0.4 * b + 0.5 * (c == "x") + 0.3 * (v - 2002) - 1.5)))).astype(int)
    out = [(int(v[i]), int(y[i]), None if i % 11 == 0 else float(a[i]), float(b[i]), None if i % 17 == 0 else str(c[i])) for i in range(n)]
    out += [(2004, int(i < 3), 0.1, 0.2, "x") for i in range(50)]  # too few defaults to be held out
    return spark.createDataFrame(out, "vintage_year int, y int, a double, b double, c string").repartition(3).cache()


def refitted(rows, numeric, categorical, left_out):
    train = rows if left_out is None else rows.filter(F.col("vintage_year") != left_out)
    return scorecard.fit_scorecard(train, "y", numeric, categorical, min_iv=0.001)


def test_equal_to_refitting_each_card(rows):
    got = {(r["candidate"], r["vintage"]): (r["defaults"], r["gini"], r["pred_over_obs"]) for r in folds.leave_one_vintage_out(rows, SETS, min_iv=0.001).collect()}
    assert set(got) == {(s, v) for s in SETS for v in (2001, 2002)}
    for (name, v), (bad, gini, ratio) in got.items():
        held = rows.filter(F.col("vintage_year") == v)
        one = metrics.evaluate(refitted(rows, *SETS[name], v).predict_pd(held, "p"), "y", "p").first()
        assert bad == one["defaults"]
        assert gini == pytest.approx(one["gini"], abs=1e-4) and ratio == pytest.approx(one["mean_predicted_pd"] / one["default_rate"], abs=1e-4)


def test_bands_and_woe_are_refitted_without_the_vintage(rows):
    for fold in folds.fit_folds(rows, ["a", "b"], ["c"], [None, 2002], "y", "vintage_year"):
        train = rows if fold.left_out is None else rows.filter(F.col("vintage_year") != fold.left_out)
        specs = binning.fit_bins(train, "y", ["a", "b"], ["c"])
        assert fold.specs == specs and fold.rows == train.count()
        table = binning.woe_table(train, specs, "y").collect()
        for f, woe in binning.woe_by_band(table, specs).items():
            assert fold.woe[f] == pytest.approx(woe, abs=1e-12)
            assert fold.iv[f] == pytest.approx(sum(r["iv_part"] for r in table if r["feature"] == f), abs=1e-12)


def test_refit_without_one_vintage(rows):
    table = {(r["left_out"], r["vintage"]): r for r in folds.refit_without_vintage(rows, ["a", "b"], ["c"], 2001, min_iv=0.001).collect()}
    assert set(table) == {(o, v) for o in ("all", "2001") for v in (2001, 2002, 2004)}
    for out in (None, 2001):
        scored = refitted(rows, ["a", "b"], ["c"], out).predict_pd(rows, "p")
        for r in metrics.level_table(scored, "y", "p", ["vintage_year"]).collect():
            mine = table[str(out or "all"), r["vintage_year"]]
            assert mine["loans"] == r["loans"] and mine["predicted_rate"] == pytest.approx(r["predicted_rate"], abs=1e-5)


def test_no_feature_is_an_error(rows):
    with pytest.raises(ValueError, match="no feature of both"):
        folds.leave_one_vintage_out(rows, SETS, min_iv=99.0)


def test_sets_without_a_feature_are_fitted_by_their_constant(rows):
    got = folds.leave_one_vintage_out(rows, SETS, min_iv=99.0, allow_constant=True).collect()
    counts = {r["vintage_year"]: (r["n"], r["bad"]) for r in rows.groupBy("vintage_year").agg(F.count("y").alias("n"), F.sum("y").alias("bad")).collect()}
    n, bad = (sum(c[i] for c in counts.values()) for i in (0, 1))
    assert len(got) == 4
    for r in got:
        own_n, own_bad = counts[r["vintage"]]
        assert r["gini"] == 0 and r["pred_over_obs"] == pytest.approx((bad - own_bad) / (n - own_n) / (own_bad / own_n), abs=1e-6)
    assert len(folds.refit_without_vintage(rows, ["a", "b"], ["c"], 2001, min_iv=99.0, allow_constant=True).collect()) == 6


def test_card_of_the_constant_alone(rows):
    train = rows.withColumnRenamed("a", "ltv")
    with pytest.raises(ValueError, match="no feature reaches"):
        scorecard.fit_scorecard(train, "y", ["ltv"], [], min_iv=99.0)
    card = scorecard.fit_scorecard(train, "y", ["ltv"], [], min_iv=99.0, allow_constant=True)
    record = card.export("fitted")
    assert card.points_rows() == [] and card.sign_violations() == [] and scoring.model_problems(record) == []
    both = scoring.score_batch(record, card.score_points(card.predict_pd(train, "p"), "points")).agg(
        F.min("p"), F.max("p"), F.min("pd"), F.max("pd"), F.max(F.abs(F.col("score") - F.col("points"))), F.avg("y")).first()
    assert both[:4] == pytest.approx([both[5]] * 4, abs=1e-9) and both[4] < 1e-9
