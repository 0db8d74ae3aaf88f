"""Early stopping keeps the round that serves the hold-out best."""

import threading

import numpy as np

from loanloom import settings as S
from loanloom.operators import challengers
from loanloom.plans import QUERIES, modelling


def loans(spark, n=800, signal=2.0):
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=(2, n))
    y = (rng.random(n) < 1 / (1 + np.exp(-(signal * a - 1)))).astype(int)
    return spark.createDataFrame([(f"k{i}", int(t), float(u), float(v)) for i, (t, u, v) in enumerate(zip(y, a, b))], "loan_seq string, y int, a double, b double")


def losses_of(model, preparation, held):
    ready = preparation.transform(held.withColumn("_y", held.y.cast("double")).selectExpr("*", "1.0D AS _w"), ["_y", "_w"])
    return model.evaluateEachIteration(ready)


def test_the_round_kept_is_the_best_one(spark):
    df = loans(spark)
    m = challengers.fit_boosted_trees(df, trees=45, step=0.3, patience=6, numeric=["a", "b"], categorical=[])
    best = m.losses.index(min(m.losses)) + 1
    assert m.model.getNumTrees == m.rounds == best
    assert len(m.losses) == min(45, best + 6) and min(m.losses) < m.losses[0]
    inner, held = challengers.stratified_split(df, "y", "loan_seq", S.TREES["held_share"], "inner")
    again = losses_of(m.model, m.preparation, held)
    assert np.allclose(again, m.losses[:best])  # rounds don't depend on how many follow


def test_the_limit_holds_without_a_best_round_in_sight(spark):
    m = challengers.fit_boosted_trees(loans(spark, 500), trees=4, step=0.01, patience=6, numeric=["a", "b"], categorical=[])
    assert len(m.losses) == 4 and m.model.getNumTrees == m.rounds
    assert (S.TREES["limit"], S.TREES["step"], S.TREES["patience"]) == (600, 0.05, 40)


def test_no_tree_is_grown_twice_once_the_best_round_is_known(spark, monkeypatch):
    grown = []
    classifier = challengers.boosted_classifier
    monkeypatch.setattr(challengers, "boosted_classifier", lambda trees, *more: grown.append(trees) or classifier(trees, *more))
    df = loans(spark)
    m = challengers.fit_boosted_trees(df, trees=20, step=0.3, patience=6, numeric=["a", "b"], categorical=[])
    assert grown == [20] and m.model.getNumTrees == m.rounds < 20  # cut, not fitted again
    inner, _held = challengers.stratified_split(df, "y", "loan_seq", S.TREES["held_share"], "inner")
    again = challengers.fit_trees(inner, m.rounds, preparation=m.preparation)
    assert again.model.getNumTrees == m.rounds and m.model.numClasses == 2
    ps = m.predict(df, ["loan_seq"]).agg({"p": "min", "*": "count"}).first()
    assert 0 < ps["min(p)"] < 0.5 and ps["count(1)"] == df.count()


def test_the_models_of_predict_pd_are_fitted_at_the_same_time(spark, sf, monkeypatch):
    together = threading.Barrier(3, timeout=60)
    card, logistic = modelling.card, challengers.fit_logistic_baseline
    monkeypatch.setattr(modelling, "card", lambda *args: together.wait() >= 0 and card(*args))
    monkeypatch.setattr(challengers, "fit_logistic_baseline", lambda *args, **more: together.wait() >= 0 and logistic(*args, **more))
    monkeypatch.setattr(modelling, "boosted", lambda spark, sf: together.wait() >= 0 and logistic(modelling.train_rows(spark, sf), **modelling.FEATS))
    counts = {r["model"]: r["count"] for r in QUERIES["predict_pd"](spark, sf).groupBy("model").count().collect()}
    assert set(counts) == {"scorecard", "logistic", "boosted"} and len(set(counts.values())) == 1
