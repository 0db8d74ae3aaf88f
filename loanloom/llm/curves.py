"""Approximate nearest neighbours by largest inner product, along shifted Hilbert curves.

Each curve orders the vectors by the Hilbert number of a random projection, shifted at random: vectors that are near
each other are near in some of the orders.  Spark range-partitions every order and packs it into blocks; a query is
compared with the blocks of its own window of rows and of the two beside it, and the best of all curves are ranked by
their exact scores.  An extra coordinate gives all vectors one length, so that the largest inner product is the
nearest neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom.llm import vectors
from loanloom.session import write_scratch

#: Curves, coordinates of each projection and bits of a coordinate.
CURVES, AXES, BITS = 12, 4, 6
#: Rows of a block, and of a window: a query meets the blocks of its own window and of the two beside it.
BLOCK, WINDOW = 4096, 4096
#: Vectors from which the spread of the projections is learnt.
SAMPLE = 2048
#: Candidates beyond k that a block hands to the exact ranking.
MARGIN = 4


def hilbert_numbers(places: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of grid cells (one row each) along the Hilbert curve.

    Works from the top bit down on all rows at once: the cell's corner at each level says how the axes of the levels
    below are mirrored and exchanged; the Gray code of the corners makes the number.
    """
    x = [places[:, i].astype(np.uint64) for i in range(places.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        below = bit - one
        for i in range(len(x)):
            on = (x[i] & bit) != 0
            swapped = (x[0] ^ x[i]) & below
            mirrored = x[0] ^ below
            x[i] = np.where(on, x[i], x[i] ^ swapped)
            x[0] = np.where(on, mirrored, x[0] ^ swapped)
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flips = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> np.uint64(level)) & one, np.uint64((1 << level) - 1), np.uint64(0))
    number = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            number = number << one | (((axis ^ flips) >> np.uint64(level)) & one)
    return number.astype(np.int64)


class Curves:
    """The orders: random orthogonal projections, shifts, and the quantiles that spread each projected axis evenly."""

    def __init__(self, sample: np.ndarray, length: float, seed: int = 0):
        self.length = length  # of every vector with its extra coordinate
        rng = np.random.default_rng(seed)
        n = sample.shape[1] + 1
        self.axes = [np.linalg.qr(rng.standard_normal((n, n)))[0][:, : min(AXES, n)] for _ in range(CURVES)]
        self.shifts = rng.random((CURVES, AXES))
        self.grid = np.linspace(0, 1, 257)
        self.quantiles = [np.quantile(self.lifted(sample) @ a, self.grid, axis=0) for a in self.axes]

    def lifted(self, v: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.length**2 - (v * v).sum(axis=1), 0)
        return np.column_stack([v, np.sqrt(rest)])

    def asked(self, v: np.ndarray) -> np.ndarray:
        """A query's place: its direction, at full length, since its nearest neighbour doesn't depend on its own length."""
        norms = np.sqrt((v * v).sum(axis=1))
        return np.column_stack([v * (self.length / norms)[:, None], np.zeros(len(v))])

    def numbers(self, lifted: np.ndarray, curve: int) -> np.ndarray:
        y = lifted @ self.axes[curve]
        even = np.column_stack([np.interp(y[:, i], self.quantiles[curve][:, i], self.grid) for i in range(y.shape[1])])
        cells = ((even + self.shifts[curve, : y.shape[1]]) / 2 * (1 << BITS)).astype(np.int64)
        return hilbert_numbers(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows; shorter ones are filled up with zeros."""
    lists = column.to_pylist()
    if all(len(x) == dims for x in lists):
        return np.array(lists, np.float64).reshape(len(lists), dims)
    return np.array([x + [0.0] * (dims - len(x)) for x in lists], np.float64).reshape(len(lists), dims)


def _place(curves: Curves, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, v, asked = batch.column(0).to_numpy(), matrix(batch.column(1), dims), batch.column(2).to_numpy(zero_copy_only=False)
            packed = [row.tobytes() for row in v]
            sides = [(False, np.arange(len(v)), curves.lifted(v))]
            if asked.any():
                sides.append((True, np.flatnonzero(asked), curves.asked(v[asked])))
            for query, which, lifted in sides:
                for curve in range(CURVES):
                    n = len(which)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([curve] * n, pa.int32()), pa.array(curves.numbers(lifted, curve)), pa.array(reps[which]), pa.array([query] * n), pa.array([packed[i] for i in which], pa.binary())],
                        ["curve", "number", "rep", "query", "v"],
                    )

    return run


_BLOCKS = ["block", "curve", "part", "n", "reps", "m", "q_reps", "q_m"]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to blocks of about ``BLOCK`` vectors of one curve, with the queries that stand among them."""
    part, at = TaskContext.get().partitionId(), 0
    held: list[tuple] = []

    def blocks() -> Iterator[pa.RecordBatch]:
        nonlocal at
        n = sum(not row[3] for row in held)
        size = max(1, -(-n // max(1, round(n / BLOCK))))
        data, asked = ([], []), ([], [])

        def full() -> pa.RecordBatch:
            nonlocal at
            at += 1
            row = [part << 20 | at, held[0][0], part, len(data[0]), np.array(data[0], np.int64).tobytes(), b"".join(data[1]), np.array(asked[0], np.int64).tobytes(), b"".join(asked[1])]
            for side in (*data, *asked):
                side.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], _BLOCKS)

        for _, _, rep, query, v in held:
            side = asked if query else data
            side[0].append(rep)
            side[1].append(v)
            if len(data[0]) == size:
                yield full()
        if data[0] or asked[0]:
            yield full()
        held.clear()

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[0] != held[0][0] or len(held) >= 8 * BLOCK):
                yield from blocks()
            held.append(row)
    yield from blocks()


def nearest_rows(q: np.ndarray, q_reps: np.ndarray, m: np.ndarray, reps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and exact score of each query's k best of a block, itself left out."""
    out = []
    for at in range(0, len(q), 256):
        scores = q[at : at + 256] @ m.T
        scores[q_reps[at : at + 256, None] == reps[None]] = -np.inf
        n = min(k + MARGIN, len(reps))
        some = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < len(reps) else np.tile(np.arange(len(reps)), (len(scores), 1))
        for i, columns in enumerate(some):
            columns = columns[reps[columns] != q_reps[at + i]]
            exact = np.cumsum(q[at + i] * m[columns], axis=1)[:, -1] if len(columns) else np.empty(0)
            order = np.lexsort((reps[columns], -exact))[:k]
            out.append((np.full(len(order), q_reps[at + i]), reps[columns][order], exact[order]))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _meet(dims: int, k: int):
    """The best of each query of a cell among all rows of the cell and its two neighbours."""

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        out = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        reps, q_reps = (np.frombuffer(b"".join(t.column(n).to_pylist()), np.int64) for t, n in ((data, "reps"), (asked, "q_reps")))
        if len(reps) and len(q_reps):
            m, q = (np.frombuffer(b"".join(t.column(n).to_pylist())).reshape(-1, dims) for t, n in ((data, "m"), (asked, "q_m")))
            out = nearest_rows(q, q_reps, m, reps, k)
        return pa.table(dict(zip(("query", "rep", "score"), out, strict=True)))

    return run


def search(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's k best found (see ``vectors.EVERY``).

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without id; shorter
    vectors count as filled up with zeros; repeated rows count once, equal vectors each, ties to the smaller id; other
    columns are left out; without candidates there are no rows.  The score is the inner product in double precision.
    """
    vectors_ = vectors.usable(rows, key, vector).filter(F.exists("v", lambda x: x != 0))
    table, queries = vectors.classes(vectors_, k)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = table.agg(F.max(F.size("v")).alias("dims"), F.max(square).alias("square"), F.count("*").alias("n")).first()
    dims = facts["dims"] or 1
    sample = [r["v"] for r in table.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").collect()]
    curves = Curves(matrix(pa.array(sample or [[0.0]], pa.list_(pa.float64())), dims), (facts["square"] or 1.0) ** 0.5)

    placed = table.select("rep", "v", "query").mapInArrow(_place(curves, dims), "curve int, number long, rep long, query boolean, v binary")
    parts = max(1, -(-CURVES * facts["n"] // (4 * BLOCK)))
    order = ("curve", "number", "rep", "query")
    packed = placed.repartitionByRange(parts, *order[:3]).sortWithinPartitions(*order)
    blocks = write_scratch(packed.mapInArrow(_pack, "block long, curve long, part long, n long, reps binary, m binary, q_reps binary, q_m binary"), "blocks")

    before = Window.partitionBy("curve").orderBy("block")  # one row a block
    end = F.sum("n").over(before)
    cell = F.floor((end - F.col("n") / 2) / WINDOW)  # where the middle of the block lies, in windows
    cells = write_scratch(blocks.select("block", "curve", cell.alias("cell")), "cells")
    near = cells.select("block", "curve", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    data = blocks.select("block", "reps", "m").join(near, "block").groupBy("curve", "cell")
    asked = blocks.filter(F.octet_length("q_reps") > 0).select(F.col("block").alias("asker"), "q_reps", "q_m")
    home = cells.select(F.col("block").alias("asker"), F.col("curve").alias("on"), F.col("cell").alias("home"))
    met = data.cogroup(asked.join(home, "asker").groupBy("on", "home")).applyInArrow(_meet(dims, k), "query long, rep long, score double")
    found = write_scratch(met.groupBy("query", "rep").agg(F.max("score").alias("score")), "found")
    own = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return vectors.results(found, table, queries, own, k)
