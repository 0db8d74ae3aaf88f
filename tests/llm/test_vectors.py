import numpy as np
import pytest

from loanloom.llm import curves, pivots

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, rep string, query string, score string, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, *"??????") for i, v in rows], SCHEMA).repartition(3)


def awkward(seed=0, n=260, d=6):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(d).astype(np.float32).tolist()) for i in range(n)]
    same = rng.standard_normal(d).astype(np.float32).tolist()
    rows += [(1000 + i, same) for i in range(60)]  # one very common vector, queries among it
    rows += [(2000, None), (2020, [float("nan")] * d), (2040, [None] + [1.0] * (d - 1)), (2060, [float("inf")] * d), (2080, [0.0] * d), (None, same), (2100, same), (2100, same), (2120, [0.5, 0.5])]
    return rows


def brute(rows, scale, keep, k=20):
    d = max(len(v) for _, v in rows if v)
    seen = sorted({(i, tuple(v) + (0.0,) * (d - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    seen = [(i, scale(np.array(v, np.float64))) for i, v in seen]
    seen = [(i, v) for i, v in seen if keep(v)]
    out = {}
    for i, v in seen:
        if i % 20 == 0:
            out[i] = sorted((-float(np.cumsum(v * w)[-1]), j) for j, w in seen if j != i)[:k]
    return out


def test_pivot_search_is_exact(spark):
    rows = awkward()
    found = pivots.search(table(spark, rows)).collect()
    expected = brute(rows, lambda v: np.floor(64 * v), lambda v: True)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == {q: [(int(s), j) for s, j in x] for q, x in expected.items()}


def test_pivot_search_in_many_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("ASKERS", 4), ("FIRST", 2), ("TOGETHER", 2), ("STRIDE", 4)):
        monkeypatch.setattr(pivots, name, value)
    rows = awkward(3, 150)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in pivots.search(table(spark, rows)).collect()}
    expected = brute(rows, lambda v: np.floor(64 * v), lambda v: True)
    assert got == {(q, n + 1): (j, int(-s)) for q, x in expected.items() for n, (s, j) in enumerate(x)}


def test_neighbours_along_curves(spark):
    rows = awkward(1)
    found = curves.search(table(spark, rows)).collect()
    expected = brute(rows, lambda v: v, lambda v: v.any())
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == expected  # the windows hold the whole table here


def test_recall_with_small_windows(spark, monkeypatch):
    monkeypatch.setattr(curves, "BLOCK", 64)
    monkeypatch.setattr(curves, "WINDOW", 64)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16)) * 2
    rows = [(i, (centres[i % 40] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(1200)]
    found = curves.search(table(spark, rows)).collect()
    expected = brute([(i, np.float32(v).tolist()) for i, v in rows], lambda v: v, lambda v: True)
    hits = sum(r.vec_id in {j for _, j in expected[r.query_id]} for r in found)
    assert hits >= 0.9 * sum(map(len, expected.values()))


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_numbers_walk_through_every_cell(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    order = np.argsort(curves.hilbert_numbers(cells, bits))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()
    assert sorted(curves.hilbert_numbers(cells, bits)) == list(range(len(cells)))


@pytest.mark.parametrize("search", [curves.search, pivots.search])
def test_empty_and_lonely(spark, search):
    assert search(table(spark, []).filter("false")).count() == 0
    assert search(table(spark, [(20, [1.0, 2.0])])).count() == 0
