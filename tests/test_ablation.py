"""Arms of the imbalance ablation differ in the treatment of the imbalance only."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.operators import challengers


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 1500
    a, b = rng.normal(size=(2, n)).round(3)
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * a - 2.6)))).astype(int)
    out = [(f"k{i}", int(y[i]), None if i % 9 == 0 else float(a[i]), float(b[i]), "xyz"[i % 3]) for i in range(n)]
    return spark.createDataFrame(out, "loan_seq string, y int, a double, b double, c string").repartition(3).cache()


def test_levels_before_and_after_calibration(rows):
    train, cal = rows.filter(F.crc32("loan_seq") % 2 == 0), rows.filter(F.crc32("loan_seq") % 2 == 1)
    arms = challengers.imbalance_ablation(train, cal, 5, numeric=["a", "b"], categorical=["c"])
    assert [a.arm for a in arms] == list(challengers.ARMS)
    observed = cal.agg(F.avg("y")).first()[0]
    means = {a.arm: a.versions(cal, ["y"]).agg(*[F.avg(v) for v in ("raw", "platt", "isotonic")]).first() for a in arms}
    # balancing lifts the raw level far above the observed one; calibration takes it back
    assert abs(means["unweighted"][0] - observed) < 0.1
    for arm in ("class_weights", "smote"):
        assert means[arm][0] > means["unweighted"][0] + 0.1
    for arm in challengers.ARMS:
        assert means[arm][1] == pytest.approx(observed, abs=1e-4) and means[arm][2] == pytest.approx(observed, abs=1e-4)
    for a in arms:
        assert a.model.model.getNumTrees == 5
        assert len(a.model.preparation.columns) == len(arms[0].model.preparation.columns) > 4  # values, flags and categories


def test_unknown_arm(rows):
    with pytest.raises(ValueError, match="unknown arm"):
        challengers.fit_arm(rows, "other", 3, numeric=["a"], categorical=[])


def test_arms_are_fitted_at_the_same_time(rows, monkeypatch):
    fit, together = challengers.fit_arm, threading.Barrier(len(challengers.ARMS), timeout=60)
    monkeypatch.setattr(challengers, "fit_arm", lambda *args: together.wait() >= 0 and fit(*args))
    arms = challengers.imbalance_ablation(rows, rows, 2, numeric=["a", "b"], categorical=["c"])
    assert [a.arm for a in arms] == list(challengers.ARMS)


def test_rows_of_the_arms_are_prepared_while_the_number_of_trees_is_found(rows, monkeypatch):
    prepared, ready = threading.Semaphore(0), challengers.arm_rows
    monkeypatch.setattr(challengers, "arm_rows", lambda *args: [ready(*args), prepared.release()][0])
    found = []

    def trees():
        found.append(all(prepared.acquire(timeout=120) for _ in challengers.ARMS))
        return 2

    arms = challengers.imbalance_ablation(rows, rows, trees, numeric=["a", "b"], categorical=["c"])
    assert found == [True] and [a.model.model.getNumTrees for a in arms] == [2] * 3
