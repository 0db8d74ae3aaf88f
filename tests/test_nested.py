"""Nested folds of all seeds and variants at once against folds fitted one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.operators import challengers, nested

FOLDS, SEEDS = 3, ("a", "b")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(21)
    n = 400
    a, b = rng.normal(size=(2, n)).round(3)
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.2 * a - 0.5 * b - 1.6)))).astype(int)
    out = [(f"k{i}", int(y[i]), None if i % 13 == 0 else float(a[i]), float(b[i])) for i in range(n)]
    return spark.createDataFrame(out, "loan_seq string, y int, a double, b double").repartition(3).cache()


@pytest.fixture(scope="module")
def preparation(rows):
    return challengers.prep_features(rows, "y", ["a", "b"], [])


@pytest.fixture(scope="module")
def placed(rows, preparation):
    return nested.placed_rows(rows, "y", "loan_seq", preparation, SEEDS)


def logistic(x, t, w, penalty):
    """Newton's method on one model."""
    x, beta = np.hstack([np.ones((len(x), 1)), x]), np.zeros(x.shape[1] + 1)
    ridge = np.append(0.0, np.full(x.shape[1] - 1, penalty))
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ beta)))
        beta = beta + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (w * (t - p)) - ridge * beta)
    return beta


def folds_of(frame):
    """Row numbers dealt out one after the other within each class, in order of place."""
    fold = np.zeros(len(frame), int)
    for c in (0, 1):
        mine = np.flatnonzero(frame["y"] == c)
        fold[mine[np.argsort(frame["place"].to_numpy()[mine])]] = np.arange(len(mine)) % FOLDS
    return fold


def expit(z):
    return 1 / (1 + np.exp(-z))


def one_by_one(frame, variant):
    """key -> (raw, calibrated)"""
    frame = frame.reset_index(drop=True)
    outer, out = folds_of(frame), {}
    for o in range(FOLDS):
        train, test = frame[outer != o].reset_index(drop=True), frame[outer == o]
        inner = folds_of(train)

        def fit(part):
            x, t = np.stack(part["x"]), part["y"].to_numpy().astype(float)
            return logistic(x, t, np.where(t == 1, (t == 0).sum() / t.sum(), 1.0) if variant == "class_weights" else np.ones(len(t)), 1.0)

        def z(beta, part):
            return beta[0] + np.stack(part["x"]) @ beta[1:]

        raw, parts = expit(z(fit(train), test)), []
        for i in range(FOLDS):
            beta, fresh = fit(train[inner != i]), train[inner == i]
            bad = fresh["y"].sum()
            t = np.where(fresh["y"] == 1, (bad + 1) / (bad + 2), 1 / (len(fresh) - bad + 2))
            off, slope = logistic(z(beta, fresh)[:, None], t, np.ones(len(t)), 0.0)
            parts.append(expit(off + slope * z(beta, test)))
        out |= dict(zip(test["key"], zip(raw, np.mean(parts, axis=0))))
    return out


def test_equal_to_folds_fitted_one_by_one(rows, preparation, placed):
    got = nested.stratified_kfold(rows, "y", "loan_seq", preparation, FOLDS, SEEDS, ("unweighted", "class_weights")).toPandas()
    assert len(got) == 400 * 2 * 2 * 2
    table = placed.toPandas()
    for number, seed in enumerate(SEEDS):
        for variant in ("unweighted", "class_weights"):
            expected = one_by_one(table[table["seed"] == number], variant)
            for at, kind in enumerate(("raw", "calibrated")):
                mine = got[(got["seed"] == seed) & (got["variant"] == variant) & (got["kind"] == kind)].set_index("key")["p"]
                assert len(mine) == 400 and np.allclose(mine, [expected[k][at] for k in mine.index], atol=1e-7)


def test_folds_hold_their_share_of_each_class_and_seeds_differ(placed):
    table = placed.toPandas()
    for (_seed, _y), part in table.groupby(["seed", "y"]):
        assert sorted(part["place"]) == list(range(len(part)))
    a, b = (table[table["seed"] == s].set_index("key")["place"] for s in (0, 1))
    assert (a != b.reindex(a.index)).mean() > 0.9


def test_closed_forms_of_the_layout():
    for n in (6, 7, 20, 23):
        layout, places = nested.Layout(1, FOLDS, (n, n)), np.arange(n)
        assert [layout.size(s, 0) for s in range(layout.sets)] == layout.trains(places).sum(0).tolist()
        for o in range(FOLDS):
            left = places[places % FOLDS != o]
            assert nested.moved(left, o, FOLDS).tolist() == list(range(len(left)))


def test_made_up_rows_balance_each_set_from_its_own_rows(placed):
    table = placed.toPandas()
    totals = table[table["seed"] == 0]["y"].value_counts()
    layout = nested.Layout(len(SEEDS), FOLDS, (int(totals[0]), int(totals[1])))
    bases = nested.smote_bases(placed, layout, 4)
    frame = bases.toPandas()
    for number in range(layout.sets):
        seed, outer, inner = layout.parts(number)
        mine = table[(table["seed"] == seed) & (table["y"] == 1)].reset_index(drop=True)
        inside = layout.trains(mine["place"].to_numpy())[:, outer * (FOLDS + 1) + inner]
        own = np.stack(mine["x"])[inside]
        part = frame[frame["set"] == number]
        assert part["copies"].sum() == layout.size(number, 0) - layout.size(number, 1)
        x, mates = np.stack(part["x"]), [np.stack(m) for m in part["mates"]]
        for row, near in zip(x, mates):
            d = np.sort(((own - row) ** 2).sum(1))[1:5]
            assert np.allclose(((near - row) ** 2).sum(1), d)
        new = nested.made_up(part["h"].to_numpy(), part["first"].to_numpy(), part["copies"].to_numpy(), x, mates)
        owners = np.repeat(np.arange(len(part)), part["copies"])
        for point, i in zip(new, owners):
            gaps = np.linalg.norm(mates[i] - point, axis=1) + np.linalg.norm(x[i] - point) - np.linalg.norm(mates[i] - x[i], axis=1)
            assert gaps.min() < 1e-9  # between the row and a mate


def test_smote_fit_is_where_the_gradient_vanishes(placed):
    table = placed.toPandas()
    totals = table[table["seed"] == 0]["y"].value_counts()
    layout = nested.Layout(len(SEEDS), FOLDS, (int(totals[0]), int(totals[1])))
    width = len(table["x"][0])
    weights = nested.fit_sets(placed, layout, width, ["smote"])
    frame = nested.smote_bases(placed, layout, 5).toPandas()
    for number in (0, FOLDS, layout.sets - 1):
        seed, outer, inner = layout.parts(number)
        mine = table[table["seed"] == seed]
        real = mine[layout.trains(mine["place"].to_numpy())[:, outer * (FOLDS + 1) + inner]]
        part = frame[frame["set"] == number]
        new = nested.made_up(*(part[c].to_numpy() for c in ("h", "first", "copies")), np.stack(part["x"]), [np.stack(m) for m in part["mates"]])
        x, t = np.vstack([np.stack(real["x"]), new]), np.append(real["y"], np.ones(len(new))).astype(float)
        assert t.mean() == pytest.approx(0.5)
        assert np.allclose(weights[number], logistic(x, t, np.ones(len(t)), 1.0), atol=1e-6)


def test_stated_cases(spark, rows, preparation):
    none = nested.stratified_kfold(rows.limit(0), "y", "loan_seq", preparation)
    assert none.count() == 0 and none.columns == ["variant", "kind", "seed", "fold", "key", "y", "p"]
    with pytest.raises(ValueError, match="at least 10 rows"):
        nested.stratified_kfold(rows.filter("y = 0"), "y", "loan_seq", preparation)
    with pytest.raises(ValueError, match="unknown variants"):
        nested.stratified_kfold(rows, "y", "loan_seq", preparation, variants=["other"])
    unknown = rows.limit(60).withColumn("y", F.lit(None).cast("int"))
    more = nested.stratified_kfold(rows.unionByName(unknown), "y", "loan_seq", preparation, FOLDS, ("a",), ("unweighted",))
    assert more.count() == 400 * 2


def _nearest_sets(bases):
    """(set, h, first) -> mates"""
    return {(r["set"], r["h"], r["first"]): [tuple(m) for m in r["mates"]] for r in bases.collect()}


def test_neighbours_are_searched_once_for_all_sets(placed, monkeypatch):
    layout = nested.Layout(len(SEEDS), FOLDS, tuple(placed.filter("seed = 0").filter(F.col("y") == y).count() for y in (0, 1)))
    searched, search = [], nested.nearest_neighbours
    monkeypatch.setattr(nested, "nearest_neighbours", lambda df, *args, **more: searched.append(df.count()) or search(df, *args, **more))
    once = _nearest_sets(nested.smote_bases(placed, layout, 4))
    assert searched == [layout.totals[1]]
    # rows that one search leaves with too few are searched in their sets
    monkeypatch.setattr(nested, "SPARE", 0.25)
    again = _nearest_sets(nested.smote_bases(placed, layout, 4))
    assert len(searched) == 3 and again == once and all(len(m) == 4 for m in once.values())


def test_minority_rows_are_stored_once_a_seed_and_fits_begin_at_the_fit_of_all_rows(placed, monkeypatch):
    """They were stored once for each set that they train, and every set's fit began at zero."""
    layout = nested.Layout(len(SEEDS), FOLDS, tuple(placed.filter("seed = 0").filter(F.col("y") == y).count() for y in (0, 1)))
    stored, _searched = nested.nearest_in_sets(placed, layout, 4)
    assert stored.count() == layout.totals[1] * len(SEEDS)
    starts, newton = {}, nested._newton
    monkeypatch.setattr(nested, "_newton", lambda sums, models, width, ridge, start: starts.update({models: start}) or newton(sums, models, width, ridge, start))
    nested.fit_sets(placed, layout, len(placed.first()["x"]), list(nested.VARIANTS))
    assert not starts[2].any() and starts[3 * layout.sets].all(axis=1).all()


def test_sums_of_one_model_are_those_of_many():
    draw = np.random.default_rng(1)
    x, y, weights = draw.standard_normal((50, 4)), draw.integers(0, 2, 50), draw.standard_normal((4, 2))
    counts = draw.random((50, 2))
    many, each = nested._Sums(2, 4), nested._Sums(2, 4)
    many.add(np.arange(2), x, y, weights, counts)
    for m in range(2):
        each.add(np.array([m]), x, y, weights[:, [m]], counts[:, [m]])
    assert np.allclose(many.values, each.values)
