from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from loanloom.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v string, code string, part string, error string, of string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, x, *"??????") for i, v, x in rows], SCHEMA).repartition(3)


def vectors(seed=0, n=400, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    return [(int(i), (centres[i % 12] + 0.2 * rng.standard_normal(d)).tolist(), int(i) % 3) for i in rng.permutation(n)]


def brute(rows, entries=256, rounds=4, parts=4):
    """Every part against every entry, with Python's integers."""
    kept = [(i, [int(np.floor(1024.0 * x)) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], []
    longest = max(len(v) for _, v, _ in kept)
    width = -(-longest // parts)
    kept = [(i, v + [0] * (width * parts - len(v)), y) for i, v, y in kept]
    named = {}
    for i, v, _ in kept:
        if i is not None:
            named[i] = min(v, named.get(i, v))
    first = [named[i] for i in sorted(named)[:entries]] or [min(v for _, v, _ in kept)]
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[cut(v, p) for v in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [(nearest(cut(v, p), book)[1], cut(v, p)) for _, v, _ in kept]
            for e in {e for e, _ in own}:
                members = [x for f, x in own if f == e]
                book[e] = tuple(sum(c) // len(members) for c in zip(*members, strict=True))
    out, by_label = [], Counter()
    for i, v, y in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[y] += error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, y))
    digest = sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    most = 2**63 - 1
    return sorted(((str(i), c, min(e, most), min(by_label[y], most)) for i, c, e, y in out)), digest


def found(spark, rows, **options):
    coded, books = vector_codes.compress(table(spark, rows), **options)
    got = vector_codes.label_errors(coded).collect()
    return sorted((str(r.id), r.code, r.error, r.label_error) for r in got), vector_codes.books_digest(books)


AWKWARD = [
    (500, None, 1), (501, [float("nan")] * 8, 1), (502, [None] + [1.0] * 7, 1), (503, [float("inf")] * 8, 1), (504, [0.0] * 8, None), (505, [], None),
    (None, [0.5] * 8, 2), (None, [-0.5] * 8, None), (7, [0.25] * 8, 0), (7, [0.25] * 8, 0), (506, [0.1, 0.2, 0.3], 1), *((600 + i, [0.125] * 8, 5) for i in range(300)),
]


@pytest.mark.parametrize(("first", "fewest"), [(16, 2), (2, 1), (64, 64)])
def test_codes_equal_brute_force(spark, monkeypatch, first, fewest):
    monkeypatch.setattr(vector_codes, "FIRST", first)
    monkeypatch.setattr(vector_codes, "FEWEST", fewest)
    rows = vectors() + AWKWARD
    assert found(spark, rows) == brute(rows)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [float(i % 5), float(i % 3), 0.0, float(i % 2)], 0) for i in range(90)]
    assert found(spark, rows, entries=16) == brute(rows, entries=16)


def test_large_components(spark):
    rows = vectors(1, 60, 4) + [(-1, [3e6, -3e6, 1.0, 2.0], 1), (900, [2.5e6, -3e6, 4e15, 2.0], 1), (901, [2e12, 1.0, 4e15, 2.0], 1)]
    assert found(spark, rows, entries=20) == brute(rows, entries=20)
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(table(spark, [(1, [1e300] * 4, 0)]))


def test_few_rows_or_none(spark):
    assert vector_codes.compress(table(spark, []))[0].collect() == []
    assert vector_codes.compress(table(spark, [(1, None, 2)]))[0].collect() == []
    for rows in ([(None, [1.0, 2.0, 3.0, 4.0], None)], [(3, [], 1)], [(2, [0.5, 1.0, 2.0, 3.0, 5.0], 1), (1, [0.0] * 5, 1)]):
        assert found(spark, rows) == brute(rows)


def test_bounds_save_work():
    """Once the entries stand still nearly, few of them are looked at, and the codes are those of a full search."""
    rng = np.random.default_rng(3)
    v = np.floor(1024 * rng.standard_normal((2000, 2))).astype(np.int64)
    books = v[:64]
    moved = books + rng.integers(-3, 4, books.shape)
    before = vector_codes.PartState(v, books, 16)
    before.start()
    after = vector_codes.PartState(v, moved, 16)
    after.move(before.own, before.near, before.low, before.outer, vector_codes.roots(vector_codes.pair_distances(books, moved)))
    assert (after.own == vector_codes.all_distances(v, moved).argmin(axis=1)).all()
    assert after.used[-1] == 0 and (after.used[:-1] * np.arange(65)).sum() < 0.1 * 64 * len(v)
    assert vector_codes.next_size(16, 64, after.used.tolist()) < 16
    assert vector_codes.next_size(16, 64, [10, 0, 0, 5]) == 32 and vector_codes.next_size(64, 256, [10, 0, 0, 5]) == 64


def test_bounds_are_kept_from_below():
    x = np.array([0.0, -3.0, 1e-30, 0.1, 1.0, 511.9, 512.0, 1e19, np.inf])
    short = vector_codes._long(vector_codes._short(x))
    assert (short <= np.maximum(x, 0)).all() and (short[3:8] > 0.99 * x[3:8]).all()
