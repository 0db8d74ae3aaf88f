"""Exact top-k search by inner product, with a table of distances to many pivots.

Components become integers.  An extra coordinate gives all vectors one length, so that the largest inner product is the
least distance; for any pivot p, |d(q, p) - d(x, p)| is a lower bound of d(q, x).  The greatest such bound over all
pivots orders the candidates, which are evaluated until no bound can reach the k-th score found.  Blocks of candidates
know the range of their distances to each pivot, so that whole blocks are passed over in the same way: a query block
first meets the few blocks of least bound, which gives every query a score to beat, then those that may still beat it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom.llm import vectors
from loanloom.llm.curves import matrix
from loanloom.session import write_scratch

#: Components are multiplied by this and rounded down.
SCALE = 64
#: Pivots, and vectors they are chosen from.
PIVOTS, SAMPLE = 32, 1024
#: Candidates and queries in a block; blocks a query block meets first; query blocks that meet a block in one task.
BLOCK, ASKERS, FIRST, TOGETHER = 4096, 1024, 4, 16
#: Candidates evaluated between two looks at the bounds.
STRIDE = 512


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those chosen."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if not far.max():
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


class Pivots:
    def __init__(self, sample: np.ndarray, square: float):
        self.square = square  # of every candidate's length with its extra coordinate
        self.points = choose_pivots(self.lifted(sample))

    def lifted(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(self.square - (v * v).sum(axis=1), 0))])

    def distances(self, v: np.ndarray, query: bool) -> np.ndarray:
        """To each pivot; a query's extra coordinate is 0."""
        lifted = np.column_stack([v, np.zeros(len(v))]) if query else self.lifted(v)
        squares = (lifted * lifted).sum(axis=1)[:, None] + (self.points**2).sum(axis=1) - 2 * lifted @ self.points.T
        return np.sqrt(np.maximum(squares, 0))

    @property
    def slack(self) -> float:
        """More than rounding can take from a bound on a score."""
        return 1e-5 * self.square + 1e-3


def _home(pivots: Pivots, dims: int, query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = pivots.distances(matrix(batch.column(1), dims), query)
            home = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])], ["rep", "v", "home", "far"])

    return run


def _pack(pivots: Pivots, dims: int, query: bool, size: int):
    """Rows in order to blocks: ids, vectors, distances to the pivots, and the least and greatest of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            nonlocal at, held
            at += 1
            reps, v = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            d = pivots.distances(v, query)
            longest = float((v * v).sum(axis=1).max())
            row = [part << 20 | at, reps.tobytes(), v.tobytes(), d.tobytes(), d.min(axis=0).tolist(), d.max(axis=0).tolist(), longest]
            held = []
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["block", "reps", "m", "d", "low", "high", "longest"])

        n = 0
        for batch in batches:
            reps, v = batch.column(0).to_numpy(), matrix(batch.column(1), dims)
            while len(reps):
                take = size - n
                held.append((reps[:take], v[:take]))
                n += len(held[-1][0])
                reps, v = reps[take:], v[take:]
                if n == size:
                    yield block()
                    n = 0
        if held:
            yield block()

    return run


def blocks_of(table: DataFrame, pivots: Pivots, dims: int, query: bool, size: int, n: int) -> DataFrame:
    """The vectors of a table in blocks of those that share their nearest pivot and lie about as far from it; written."""
    placed = table.select("rep", "v").mapInArrow(_home(pivots, dims, query), "rep long, v array<double>, home int, far double")
    ordered = placed.repartitionByRange(max(1, -(-n // (4 * size))), "home", "far", "rep").sortWithinPartitions("home", "far", "rep")
    schema = "block long, reps binary, m binary, d binary, low array<double>, high array<double>, longest double"
    return write_scratch(ordered.select("rep", "v").mapInArrow(_pack(pivots, dims, query, size), schema), "blocks")


def evaluate(q: np.ndarray, d: np.ndarray, rep: int, beat: float, m: np.ndarray, reps: np.ndarray, far: np.ndarray, pivots: Pivots, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a block for one query, among those that score ``beat`` or more: ids and scores.

    ``far`` has the block's distances to the pivots, one row a pivot.
    """
    bound = np.zeros(far.shape[1], np.float32)
    for own, theirs in zip(d, far, strict=True):
        np.maximum(bound, np.abs(theirs - np.float32(own)), out=bound)
    most = ((q @ q) + pivots.square - np.square(bound, dtype=np.float64)) / 2 + pivots.slack
    open_ = np.flatnonzero((most >= beat) & (reps != rep))
    open_ = open_[np.argsort(-most[open_], kind="stable")]
    best, scores = np.empty(0, np.int64), np.empty(0)
    for at in range(0, len(open_), STRIDE):
        some = open_[at : at + STRIDE]
        if most[some[0]] < beat:
            break
        found = m[some] @ q
        best, scores = np.concatenate([best, reps[some]]), np.concatenate([scores, found])
        order = np.lexsort((best, -scores))[:k]
        best, scores = best[order], scores[order]
        if len(best) == k:
            beat = max(beat, scores[-1])
    keep = scores >= beat if len(best) < k else slice(None)
    return best[keep], scores[keep]


def _meet(pivots: Pivots, dims: int, k: int):
    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for reps, m, far in zip(*(data.column(n).to_pylist() for n in ("reps", "m", "d")), strict=True):
            reps, m = np.frombuffer(reps, np.int64), np.frombuffer(m).reshape(-1, dims)
            far = np.ascontiguousarray(np.frombuffer(far).reshape(len(reps), -1).T, np.float32)
            for q_reps, q, d, beats in zip(*(asked.column(n).to_pylist() for n in ("q_reps", "q_m", "q_d", "beats")), strict=True):
                q_reps = np.frombuffer(q_reps, np.int64)
                q, d = np.frombuffer(q).reshape(-1, dims), np.frombuffer(d).reshape(len(q_reps), -1)
                known = {b["query"]: b["beat"] for b in beats or ()}
                for i, rep in enumerate(q_reps.tolist()):
                    best, scores = evaluate(q[i], d[i], rep, known.get(rep, -np.inf), m, reps, far, pivots, k)
                    out.append((np.full(len(best), rep), best, scores))
        columns = list(map(np.concatenate, zip(*out, strict=True))) if out else [np.empty(0, np.int64)] * 3
        return pa.table({n: c.astype(np.int64) for n, c in zip(("query", "rep", "score"), columns, strict=True)})

    return run


def search(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (integer inner product) of each query's k best, exactly.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without id; shorter vectors
    count as filled up with zeros; repeated rows count once, equal vectors each, ties to the smaller id; other columns
    are left out; without candidates there are no rows.  Scores must stay below 2**53, or the search is refused.
    """
    whole = vectors.usable(rows, key, vector).withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("double") + F.lit(0.0)))
    table, queries = vectors.classes(whole, k)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = table.agg(F.max(F.size("v")).alias("dims"), F.max(square).alias("square"), F.count("*").alias("n"), F.count_if("query").alias("asked")).first()
    dims, longest = facts["dims"] or 1, facts["square"] or 1.0
    if longest >= 2**53:
        raise ValueError("vectors are too long for exact scores")
    sample = [r["v"] for r in table.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").collect()]
    pivots = Pivots(matrix(pa.array(sample or [[0.0]], pa.list_(pa.float64())), dims), longest)

    data = blocks_of(table, pivots, dims, False, BLOCK, facts["n"])
    asked = blocks_of(table.filter("query"), pivots, dims, True, ASKERS, facts["asked"])
    nth = F.row_number().over(Window.orderBy("block")) - 1  # one row a query block
    askers = write_scratch(asked.select("block", F.col("low").alias("q_low"), F.col("high").alias("q_high"), F.col("longest").alias("q_longest"), nth.alias("asker")), "askers")
    n_askers = askers.count()
    gap = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    apart = F.array_max(F.concat(gap("q_low", "high"), gap("low", "q_high"), F.array(F.lit(0.0))))
    every = data.select(F.col("block"), "low", "high", F.explode(F.sequence(F.lit(0), F.lit(max(n_askers - 1, 0)))).alias("asker"))
    pairs = every.join(askers.drop("block"), "asker").select("block", "asker", apart.alias("apart"), ((F.col("q_longest") + longest - F.pow(apart, 2)) / 2 + pivots.slack).alias("most"))
    pairs = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("asker").orderBy("apart", "block")))
    pairs = write_scratch(pairs, "pairs")
    asked = asked.join(askers.select("block", "asker"), "block").select("asker", F.col("reps").alias("q_reps"), F.col("m").alias("q_m"), F.col("d").alias("q_d"))

    def meet(some: DataFrame, asked: DataFrame) -> DataFrame:
        some = some.withColumn("group", F.floor(F.col("asker") / TOGETHER))
        left = data.select("block", "reps", "m", "d").join(some.select("block", "group").distinct(), "block")
        right = asked.join(some.select(F.col("block").alias("theirs"), F.col("group").alias("together"), "asker"), "asker")
        met = left.groupBy("block", "group").cogroup(right.groupBy("theirs", "together"))
        return write_scratch(met.applyInArrow(_meet(pivots, dims, k), "query long, rep long, score long"), "met")

    unknown = F.lit(None).cast("array<struct<query:long,beat:double>>")
    first = meet(pairs.filter(F.col("nth") <= FIRST), asked.withColumn("beats", unknown))
    kth = vectors.best(first, k, "query", "rep").groupBy("query").agg(F.min("score").cast("double").alias("beat"), F.count("*").alias("n")).filter(F.col("n") == k)
    beats = _named(asked).join(kth, "query", "left").groupBy("asker").agg(
        F.collect_list(F.when(F.col("beat").isNotNull(), F.struct("query", "beat"))).alias("beats"), F.min(F.coalesce("beat", F.lit(float("-inf")))).alias("least")
    )
    beats = write_scratch(beats, "beats")
    left_over = pairs.filter(F.col("nth") > FIRST).join(beats.select("asker", "least"), "asker").filter(F.col("most") >= F.col("least"))
    found = first.unionByName(meet(left_over.select("block", "asker"), asked.join(beats.select("asker", "beats"), "asker")))
    own = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).cast("long")
    return vectors.results(found, table, queries, own, k)


def _named(asked: DataFrame) -> DataFrame:
    """The query ids of each query block, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(r, np.int64) for r in batch.column(1).to_pylist()]
            askers = np.repeat(batch.column(0).to_numpy(), [len(x) for x in ids])
            yield pa.RecordBatch.from_arrays([pa.array(askers), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int64))], ["asker", "query"])

    return asked.select(F.col("asker").cast("long").alias("asker"), "q_reps").mapInArrow(run, "asker long, query long")
