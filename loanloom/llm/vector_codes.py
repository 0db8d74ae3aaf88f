"""Vector code compression: product codes from integer codebooks, refitted with adaptive distance bounds.

Each vector is cut into parts, and each part is named by the nearest of its codebook's entries.  Between rounds a part
keeps its b closest entries with lower bounds of their distances, in order, and one outer bound for all other entries;
when the entries move, bounds shrink by how far.  An entry whose bound lies above the distance to the part's own entry
needs no look; the others are verified in integers, and only if the outer bound fails is the whole codebook searched.
b follows how far down the lists a round had to look.  Every decision is exact, so bounds change the work, not the codes.

The state travels with the vectors from one written table to the next, and each task adds its sums by entry to the same
table.  The driver holds the codebooks only: ``ENTRIES`` times the dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.session import discard, write_scratch

#: Integers a unit, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Scaled components lie below this in magnitude; others are refused.
LIMIT = 2.0**62
#: Entries a part keeps at first, at least and at most (three bytes each); the share of full searches from which b doubles;
#: the share of parts whose look-ups the next b must hold.  b is halved at most.
FIRST, FEWEST, MOST, MISSES, HELD = 16, 2, 64, 0.125, 0.95
#: A sum of squares below this is exact in doubles.
EXACT = 1 << 53
#: Sums travel as high * BASE + rest.
BASE = 1 << 40

STATE = "v array<long>, code binary, near binary, low binary, outer binary, part int, entry int, n long, high array<long>, rest array<long>, used array<long>"
_STATE = [*((c, pa.binary()) for c in ("code", "near", "low", "outer")), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("high", "rest", "used"))]


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def pair_distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances row by row: exact doubles, or Python's integers where those are too narrow."""
    if v.shape[1] * (_largest(v) + _largest(c)) ** 2 < EXACT:
        return ((v - c).astype(np.float64) ** 2).sum(axis=1)
    return ((v.astype(object) - c.astype(object)) ** 2).sum(axis=1)


def all_distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every entry, exact as above."""
    if v.shape[1] * (_largest(v) + _largest(c)) ** 2 < EXACT:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
    if len(v) > 1 and len(np.unique(at := np.abs(v.astype(np.float64)).max(axis=1) > 2.0**20)) > 1:  # wide rows apart
        out = np.empty((len(v), len(c)), object)
        out[at], out[~at] = all_distances(v[at], c), all_distances(v[~at], c)
        return out
    return np.stack([pair_distances(v, np.broadcast_to(e, v.shape)).astype(object) for e in c], axis=1)


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class PartState:
    """Codes of one part position for a batch: own entry, b closest entries, their lower bounds, the outer bound."""

    def __init__(self, v: np.ndarray, entries: np.ndarray, b: int):
        self.v, self.entries, self.b = v, entries, min(b, len(entries))
        self.used = np.zeros(len(entries) + 2, np.int64)  # parts by how far down the list a look was needed; last: full searches

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Own entry, closest entries, bounds and outer bound of the rows, from the whole codebook."""
        d, b = all_distances(self.v[rows], self.entries), self.b
        own = d.argmin(axis=1)
        if len(self.entries) == b:
            near, outer = np.argsort(d, axis=1), np.full(len(rows), np.inf)
            return own, near, np.take_along_axis(roots(d), near, 1), outer
        r = roots(d)
        near = np.argpartition(r, b, axis=1)[:, : b + 1]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(r, near, 1), axis=1, kind="stable"), 1)
        low = np.take_along_axis(r, near, 1)
        absent = (near[:, :b] != own[:, None]).all(axis=1)  # a tie may have put the own entry last
        near[absent, b - 1], low[absent, b - 1] = own[absent], low[absent, b]
        return own, near[:, :b], low[:, :b], low[:, b]

    def start(self) -> None:
        self.own, self.near, self.low, self.outer = self.search(np.arange(len(self.v)))

    def move(self, own: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray, shifts: np.ndarray) -> None:
        """The assignment after the entries have moved by ``shifts``, from the state before."""
        low = low - shifts[near]
        outer = outer - shifts.max(initial=0.0)
        best = pair_distances(self.v, self.entries[own])
        far = roots(best) * (1 + 1e-9) + 1e-9
        full = np.flatnonzero(outer <= far)
        rows, ranks = np.nonzero((low <= far[:, None]) & (outer > far)[:, None])
        entry = near[rows, ranks]
        d = pair_distances(self.v[rows], self.entries[entry])
        if d.dtype != best.dtype:
            d, best = d.astype(object), best.astype(object)
        low[rows, ranks] = roots(d)
        # of equal distances the lower entry wins: rows with the least (distance, entry) first
        order = np.lexsort((entry, d, rows)) if d.dtype != object else np.array(sorted(range(len(d)), key=lambda i: (rows[i], d[i], entry[i])), np.int64)
        first = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
        at = rows[first]
        better = (d[first] < best[at]) | ((d[first] == best[at]) & (entry[first] < own[at]))
        own = own.copy()
        own[at[better]] = entry[first[better]]
        deepest = np.zeros(len(self.v), np.int64)
        np.maximum.at(deepest, rows, ranks + 1)
        self.used[: near.shape[1] + 1] += np.bincount(np.delete(deepest, full), minlength=near.shape[1] + 1)
        self.used[-1] += len(full)
        self._keep(own, near, low, outer, full)

    def _keep(self, own: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray, full: np.ndarray) -> None:
        """Lists in order and b long; rows searched anew get new ones."""
        order = np.argsort(np.where(near == own[:, None], -1.0, low), axis=1, kind="stable")
        near, low = np.take_along_axis(near, order, 1), np.take_along_axis(low, order, 1)
        if near.shape[1] > self.b:
            outer = np.minimum(outer, low[:, self.b :].min(axis=1))
            near, low = near[:, : self.b], low[:, : self.b]
        elif near.shape[1] < self.b:  # a longer list comes with the next full search
            more = self.b - near.shape[1]
            near, low = np.pad(near, ((0, 0), (0, more)), mode="edge"), np.pad(low, ((0, 0), (0, more)), constant_values=np.inf)
        near, low = near.copy(), low.copy()
        if len(full):
            own[full], near[full], low[full], outer[full] = self.search(full)
        self.own, self.near, self.low, self.outer = own, near, low, outer


def _short(x: np.ndarray) -> np.ndarray:
    """Bounds as the upper halves of single-precision numbers, rounded down; a negative bound says no more than zero."""
    low = np.nextafter(np.maximum(x, 0).astype(np.float32), np.float32(0))
    return (low.view(np.uint32) >> np.uint32(16)).astype(np.uint16)


def _long(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.float64)


def _batch_vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch.column("v")
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - (np.cumsum(n) - n)[row]] = flat
    return out


def _states(batch: pa.RecordBatch, books: list[np.ndarray], sizes: list[int], old: list[np.ndarray] | None, held: list[int] | None) -> list[PartState]:
    """The parts of a batch under the codebooks; ``old`` codebooks and list lengths belong to the state in the batch."""
    n, parts = batch.num_rows, len(books)
    width = books[0].shape[1]
    v = _batch_vectors(batch, parts * width)
    states = [PartState(np.ascontiguousarray(v[:, p * width : (p + 1) * width]), books[p], sizes[p]) for p in range(parts)]
    if old is None:
        for s in states:
            s.start()
        return states
    joined = {c: b"".join(batch.column(c).to_pylist()) for c in ("code", "near", "low", "outer")}
    code, near = (np.frombuffer(joined[c], np.uint8).reshape(n, -1).astype(np.int64) for c in ("code", "near"))
    low, outer = (_long(np.frombuffer(joined[c], np.uint16).reshape(n, -1)) for c in ("low", "outer"))
    at = 0
    for p, s in enumerate(states):
        span = slice(at, at := at + held[p])
        shifts = roots(pair_distances(old[p], books[p])) * (1 + 1e-9)
        s.move(code[:, p], near[:, span], low[:, span], outer[:, p], shifts)
    return states


def _rows(x: np.ndarray) -> pa.Array:
    """Each row of an array as bytes."""
    x = np.ascontiguousarray(x)
    return pa.array([r.tobytes() for r in x], pa.binary())


def _round(books: list[np.ndarray], sizes: list[int], old: list[np.ndarray] | None, held: list[int] | None):
    """One assignment: the rows with their new state, then the task's sums by entry and its look-ups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, (entries, width) = len(books), books[0].shape
        total = np.zeros((parts, entries, width), object)
        counts = np.zeros((parts, entries), np.int64)
        used = np.zeros((parts, entries + 2), np.int64)
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or pa.schema([*(batch.schema.field(c) for c in ("id", "label", "v")), *_STATE])
            states = _states(batch, books, sizes, old, held)
            for p, s in enumerate(states):
                order = np.argsort(s.own, kind="stable")
                present, starts = np.unique(s.own[order], return_index=True)
                v = s.v[order] if _largest(s.v) * len(order) < LIMIT else s.v[order].astype(object)
                total[p, present] += np.add.reduceat(v, starts, axis=0).astype(object)
                counts[p, present] += np.diff(np.append(starts, len(order)))
                used[p] += s.used
            state = {
                "id": batch.column("id"), "label": batch.column("label"), "v": batch.column("v"),
                "code": _rows(np.stack([s.own for s in states], 1).astype(np.uint8)), "near": _rows(np.concatenate([s.near for s in states], 1).astype(np.uint8)),
                "low": _rows(_short(np.concatenate([s.low for s in states], 1))), "outer": _rows(_short(np.stack([s.outer for s in states], 1))),
            }
            yield pa.RecordBatch.from_arrays([state[f.name] if f.name in state else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)
        if schema is None:
            return
        rows = [{"part": p, "entry": -1, "used": used[p].tolist()} for p in range(parts)]
        for p, e in np.argwhere(counts):
            high, rest = zip(*(divmod(int(x), BASE) for x in total[p, e]), strict=True) if width else ((), ())
            rows.append({"part": int(p), "entry": int(e), "n": int(counts[p, e]), "high": list(high), "rest": list(rest)})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _coded(books: list[np.ndarray], sizes: list[int], old: list[np.ndarray] | None, held: list[int] | None):
    """The last assignment: code in hex and squared error (at most the largest long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = _states(batch, books, sizes, old, held)
            own = np.stack([s.own for s in states], 1).astype(np.uint8)
            errors = [[int(x) for x in pair_distances(s.v, s.entries[s.own])] for s in states]
            errors = [min(sum(x), 2**63 - 1) for x in zip(*errors, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([r.tobytes().hex() for r in own], pa.string()), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    return run


def next_size(size: int, entries: int, used: list[int]) -> int:
    """b for the next round, from how many parts needed so many entries of their list (last: a full search)."""
    looked, full = np.array(used[:-1]), used[-1]
    if full > MISSES * (looked.sum() + full):
        return min(2 * size, max(size, MOST), entries)
    if not looked.sum():
        return size
    return min(size, max(FEWEST, size // 2, int(np.searchsorted(np.cumsum(looked), HELD * looked.sum()))))


def starting_books(kept: DataFrame, width: int, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors of least keys; of several for a key the least vector.  Without any key, the least vector."""
    ids = [r.id for r in kept.select("id").filter("id is not null").distinct().orderBy("id").limit(entries).collect()]
    if ids:
        first = kept.filter(F.col("id") <= ids[-1]).groupBy("id").agg(F.min("v").alias("v")).orderBy("id")
    else:
        first = kept.agg(F.min("v").alias("v"))
    rows = [r.v for r in first.collect() if r.v is not None]
    whole = np.zeros((len(rows), width), np.int64)
    for i, v in enumerate(rows):
        whole[i, : len(v)] = v
    return np.split(whole, parts, axis=1) if rows else []


def scaled(rows: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """``id``, ``label``, ``v`` (whole numbers) of the rows whose vector and all its components are there and finite."""
    x = F.transform(vector, lambda x: x.cast("double") * scale)
    found = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("raw"), x.alias("x"))
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("x", lambda x: F.when(F.abs(x) < LIMIT, F.floor(x)).otherwise(F.raise_error(F.lit("a component is too large to be coded")).cast("long")))
    return found.filter(F.col("raw").isNotNull() & finite).select("id", "label", whole.alias("v"))


def compress(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[np.ndarray]]:
    """A written table of ``id``, ``label``, ``code`` (two hex digits a part) and ``error``, and the codebooks by part.

    Rows whose vector is null or holds null or non-finite components are dropped; every other row counts, also repeated
    ones and those without key or label.  Starting entries come from the least keys (rows without a key give none, unless
    no row has one).  Vectors shorter than the longest, or than a multiple of ``parts``, end in zeros; an empty vector is
    all zeros.  Equal distances go to the lower entry, sums are exact, and errors stop at the largest long.  Components
    of 2**62 or more after scaling stop the job with an error.  Other columns don't matter.  An empty table gives an
    empty table and no codebooks.
    """
    spark = rows.sparkSession
    kept = write_scratch(scaled(rows, key, vector, label), "scaled")
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    books = starting_books(kept, -(-longest // parts) * parts, parts, entries)
    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("id", "label")}
    coded = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    if not books:
        return spark.createDataFrame([], coded), []
    state = f"id {kinds['id']}, label {kinds['label']}, {STATE}"
    sizes, old, held = [min(FIRST, len(b)) for b in books], None, None
    for _ in range(rounds):
        after = write_scratch(kept.mapInArrow(_round(books, sizes, old, held), state), "codes")
        discard(kept)
        sums = after.filter("part is not null").select("part", "entry", "n", "high", "rest", "used")
        old, held = books, sizes
        books, sizes = _moved(sums, books, sizes)
        kept = after.filter("part is null").select("id", "label", "v", "code", "near", "low", "outer")
        kept.scratch_path = after.scratch_path
    done = write_scratch(kept.mapInArrow(_coded(books, sizes, old, held), coded), "coded")
    discard(kept)
    return done, books


def _moved(sums: DataFrame, books: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], list[int]]:
    """The next codebooks and list lengths: as many rows as the codebooks have numbers come to the driver."""
    looked = sums.filter("entry < 0").select("part", F.posexplode("used").alias("rank", "n")).groupBy("part", "rank").agg(F.sum("n").alias("n"))
    used = np.zeros((len(books), len(books[0]) + 2), np.int64)
    for r in looked.collect():
        used[r.part, r["rank"]] = r.n
    each = sums.filter("entry >= 0").select("part", "entry", "n", F.posexplode(F.arrays_zip("high", "rest")).alias("at", "sum"))
    each = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("sum.high").alias("high"), F.sum("sum.rest").alias("rest"))
    moved = [b.copy() for b in books]
    for r in each.collect():
        moved[r.part][r.entry, r["at"]] = (r.high * BASE + r.rest) // r.n
    return moved, [next_size(s, len(b), u) for s, b, u in zip(sizes, books, used.tolist(), strict=True)]


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the errors of all rows of its label (nulls together, at most the largest long)."""
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' numbers by part, entry and position, joined by commas."""
    return sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
