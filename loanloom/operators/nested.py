"""Out-of-fold predictions over stratified folds, raw and calibrated by inner folds, for every seed and variant at once.

A row's place in its class, in the order of a seed's hash, decides all its folds: the outer fold is the place modulo the
number of folds, and leaving one fold out moves the places up by a closed form, so inner folds are stratified exactly
too and classes are ranked once for each seed.  A model is fitted on the rows outside an outer fold, or outside an
outer and an inner one.  One pass over the rows adds up the normal equations of all models for one Newton step, and
one pass a step does the same for all calibrators.  The driver holds sums whose size follows from models and inputs.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions import hashing
from loanloom.operators.bootstrap import uniforms
from loanloom.operators.challengers import Preparation
from loanloom.operators.neighbours import nearest_neighbours
from loanloom.session import discard, write_scratch

VARIANTS = ("unweighted", "class_weights", "smote")
#: Newton steps at most, the gain in likelihood a step that ends them, rows whose products are held at a time, rows of a rank slice, copies of a stored row.
STEPS, TOLERANCE, HELD_ROWS, SLICE_ROWS, COPIES = 40, 1e-12, 4096, 50_000, 1024
#: How many times the neighbours needed are looked for, given the share of rows that train.
SPARE = 4


def moved(place, fold, folds: int):
    """Place of a row after every ``folds``-th one, beginning with ``fold``, is left out (for rows that stay)."""
    return place // folds * (folds - 1) + place % folds - (place % folds > fold)


def held(n: int, fold: int, folds: int) -> int:
    """How many of n places belong to a fold."""
    return max(0, -(-(n - fold) // folds))


@dataclass(frozen=True)
class Layout:
    """Numbers of models: a set of training rows is (seed, outer fold, inner fold), the last inner number leaving none out."""

    seeds: int
    folds: int
    totals: tuple[int, int]  # rows of class 0 and 1

    @property
    def sets(self) -> int:
        return self.seeds * self.folds * (self.folds + 1)

    def number(self, seed, outer, inner):
        return (seed * self.folds + outer) * (self.folds + 1) + inner

    def parts(self, number: int) -> tuple[int, int, int]:
        rest, inner = divmod(number, self.folds + 1)
        return *divmod(rest, self.folds), inner

    def size(self, number: int, y: int) -> int:
        """Training rows of a class in a set."""
        _seed, outer, inner = self.parts(number)
        n = self.totals[y] - held(self.totals[y], outer, self.folds)
        return n - (held(n, inner, self.folds) if inner < self.folds else 0)

    def copies(self, number: int) -> tuple[int, int]:
        """Made-up rows for each minority row of a set, and how many rows, by place, give one more."""
        return divmod(max(0, self.size(number, 0) - self.size(number, 1)), max(1, self.size(number, 1)))

    def trains(self, place: np.ndarray) -> np.ndarray:
        """Rows x (outer, inner) of one seed: whether a row trains."""
        k = self.folds
        out = np.zeros((len(place), k, k + 1), bool)
        for o in range(k):
            inner = moved(place, o, k) % k
            out[:, o] = (place % k != o)[:, None] & (inner[:, None] != np.arange(k + 1))
        return out.reshape(len(place), k * (k + 1))


def class_places(df: DataFrame, y: str, key: str, seeds: Sequence[str]) -> DataFrame:
    """A row for each seed, with ``seed`` (its number) and ``place``: the 0-based rank in its class by the seed's hash, then key.

    Classes are ranked in hash slices, whose number follows from the rows, so none is put in order as a whole.
    """
    slices = max(64, df.count() // SLICE_ROWS)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), F.lit(f"fold-{s}").alias("salt")) for i, s in enumerate(seeds)])).alias("s")
    rows = df.select("*", each).select("*", F.col("s.seed").alias("seed"), hashing.uniform32(F.col(key), F.col("s.salt")).alias("_u")).drop("s")
    rows = rows.withColumn("_slice", F.floor(F.col("_u") * slices / hashing.SPAN))
    earlier = Window.partitionBy("seed", y).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("seed", y, "_slice").agg(F.count(F.lit(1)).alias("n")).select(
        "seed", y, "_slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("seed", y, "_slice").orderBy("_u", key))
    placed = rows.withColumn("_inside", inside).join(offsets, ["seed", y, "_slice"])
    return placed.withColumn("place", F.col("_before") + F.col("_inside") - 1).drop("_u", "_slice", "_inside", "_before")


# ---- minority rows made up for a training set ---------------------------------------------------
BASE = "set int, h bigint, x array<double>, first int, copies int, mates array<array<double>>"
_NEAR = "seed int, key string, place bigint, x array<double>, mate_place array<bigint>, mates array<double>, short array<int>"
#: Made-up points for each file of stored minority rows.
FILE_POINTS = 1 << 18


def nearest_in_sets(rows: DataFrame, layout: Layout, k: int) -> tuple[DataFrame, DataFrame | None]:
    """Minority rows, once a seed, with as many of their nearest minority rows as their training sets use; and the made-up rows'
    bases (``BASE``) of the sets in which a row has too few of these, searched again.

    Minority rows are searched once for all sets, for more neighbours than needed: a row's nearest ones in a set are the
    first of them that train there, so a row isn't stored once a set.
    """
    f, per = layout.folds, layout.sets // layout.seeds
    bad = write_scratch(rows.filter("y = 1").select("seed", F.col("key").cast("string").alias("key"), "place", "x"), "minority")
    near = nearest_neighbours(bad.filter("seed = 0"), "key", "x", int(np.ceil(SPARE * k * (f / (f - 1)) ** 2)))
    links = near.select("key", F.posexplode("neighbours").alias("at", "mate"))
    found = links.join(bad.select("seed", F.col("key").alias("mate"), F.col("place").alias("mate_place"), F.col("x").alias("mate_x")), "mate")
    lists = found.groupBy("seed", "key").agg(F.sort_array(F.collect_list(F.struct("at", "mate_place", "mate_x"))).alias("near"))
    listed = bad.join(lists, ["seed", "key"], "left").select("seed", "key", "place", "x", F.coalesce("near.mate_place", F.array().cast("array<bigint>")).alias("mate_place"),
                                                             F.coalesce(F.flatten("near.mate_x"), F.array().cast("array<double>")).alias("mates"))
    points = sum(max(0, layout.size(s, 0) - layout.size(s, 1)) for s in range(layout.sets))
    listed = listed.mapInArrow(_used(layout, k), _NEAR).repartition(max(1, points // FILE_POINTS))
    numbers = F.sequence(F.col("seed") * per, F.col("seed") * per + per - 1)
    stored = write_scratch(listed.withColumn("h", F.transform(numbers, lambda n: F.xxhash64(F.concat_ws("|", n.cast("string"), "key")))), "mates")
    short = stored.select(F.explode("short").alias("set"), "key").select("set", F.concat_ws("|", F.col("set").cast("string"), "key").alias("id"))
    if short.isEmpty():
        return stored, None
    own = _in_sets(bad, layout)
    based = _searched_in_sets(own, own.join(short, ["set", "id"], "left_semi"), k)
    whole, more = (F.element_at(F.array(*[F.lit(v) for v in values]), F.col("set") + 1) for values in zip(*map(layout.copies, range(layout.sets)), strict=True))
    all_ = (whole + (F.col("place") < more).cast("int")).cast("int")
    based = based.filter(F.size("mates") > 0).select("set", F.xxhash64("id").alias("h"), all_.alias("all"), "x", "mates").filter("all > 0")
    each = F.explode(F.sequence(F.lit(0), F.col("all") - 1, F.lit(COPIES))).alias("first")
    return stored, write_scratch(based.select("set", "h", "x", each, "all", "mates").select("set", "h", "x", "first", F.least(F.col("all") - F.col("first"), F.lit(COPIES)).alias("copies"), "mates"), "bases")


def smote_bases(rows: DataFrame, layout: Layout, k: int) -> DataFrame:
    """(set, h, x, first, copies, mates): minority rows of every training set with their nearest minority rows in the same set.

    The made-up rows themselves are never stored: ``made_up`` draws the same ones in every pass.
    """
    stored, searched = nearest_in_sets(rows, layout, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, h, x, first, copies, count, begin, mates in _by_set(batch, layout, k):
                each = [mates[b:b + c].tolist() for b, c in zip(begin, count)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), number, np.int32)), pa.array(h), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(first.astype(np.int32)),
                                                  pa.array(copies.astype(np.int32)), pa.array(each, pa.list_(pa.list_(pa.float64())))], ["set", "h", "x", "first", "copies", "mates"])

    bases = stored.mapInArrow(run, BASE)
    return bases if searched is None else bases.unionByName(searched)


def _in_sets(bad: DataFrame, layout: Layout) -> DataFrame:
    """(set, id, place, x): every row in each set that it trains, with its place there."""
    f = layout.folds
    outer = F.filter(F.sequence(F.lit(0), F.lit(f - 1)), lambda o: o != F.col("place") % f)
    own = bad.withColumn("outer", F.explode(outer)).withColumn("after", moved_column(F.col("place"), F.col("outer"), f))
    own = own.withColumn("inner", F.explode(F.filter(F.sequence(F.lit(0), F.lit(f)), lambda i: i != F.col("after") % f)))
    last = F.when(F.col("inner") == f, F.col("after")).otherwise(moved_column(F.col("after"), F.col("inner"), f))
    number = layout.number(F.col("seed"), F.col("outer"), F.col("inner")).cast("int")
    return own.select(number.alias("set"), F.concat_ws("|", number.cast("string"), "key").alias("id"), last.alias("place"), "x")


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 1)


def _mates(batch: pa.RecordBatch, layout: Layout, k: int):
    """Of stored rows: their number of mates, and for every set of a seed, whether a mate is one of a row's first k there, and how many those are."""
    count = batch.column("mate_place").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    trains = layout.trains(batch.column("mate_place").flatten().to_numpy(zero_copy_only=False))
    so_far = np.vstack([np.zeros((1, trains.shape[1]), np.int64), np.cumsum(trains, axis=0)])
    ends = np.cumsum(count)
    pick = trains & (so_far[1:] - so_far[np.repeat(ends - count, count)] <= k)
    return count, pick, np.minimum(k, so_far[ends] - so_far[ends - count])


def _enough(batch: pa.RecordBatch, layout: Layout, k: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x sets of their seed: whether a row trains, whether the mates found are all there are or k, and the sets' numbers."""
    place, seed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "seed"))
    per = layout.sets // layout.seeds
    full = np.array([min(k, layout.size(s, 1) - 1) for s in range(layout.sets)])
    numbers = seed[:, None] * per + np.arange(per)
    return layout.trains(place), found >= full[numbers], numbers


def _used(layout: Layout, k: int):
    """Leaves out the mates that no set of a row uses, and adds the sets in which the row has too few (``_NEAR``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            count, pick, found = _mates(batch, layout, k)
            trains, enough, numbers = _enough(batch, layout, k, found)
            owner = np.repeat(np.arange(len(count)), count)
            keep = (pick & (trains & enough)[owner]).any(axis=1)
            kept = np.bincount(owner[keep], minlength=len(count))
            ends = np.append(0, np.cumsum(kept)).astype(np.int32)
            place = batch.column("mate_place").flatten().to_numpy(zero_copy_only=False)[keep]
            mates = _matrix(batch.column("mates"), len(keep))[keep]
            lists = pa.ListArray.from_arrays(pa.array(ends * mates.shape[1]), pa.array(mates.ravel()))
            short = pa.array([n[s].tolist() for n, s in zip(numbers, trains & ~enough)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("seed", "key", "place", "x")), pa.ListArray.from_arrays(pa.array(ends), pa.array(place)), lists, short],
                                             ["seed", "key", "place", "x", "mate_place", "mates", "short"])

    return run


def _by_set(batch: pa.RecordBatch, layout: Layout, k: int) -> Iterator[tuple]:
    """(set, h, x, first, copies, count, begin, mates) for each set: the bases there, a row's mates from ``begin`` on."""
    rows, per, folds = batch.num_rows, layout.sets // layout.seeds, layout.folds
    if not rows:
        return
    count, pick, found = _mates(batch, layout, k)
    trains, enough, numbers = _enough(batch, layout, k, found)
    place, h, x = batch.column("place").to_numpy(zero_copy_only=False), _matrix(batch.column("h"), rows), _matrix(batch.column("x"), rows)
    near, owner = _matrix(batch.column("mates"), int(count.sum())), np.repeat(np.arange(rows), count)
    for number in np.unique(numbers[:, 0])[:, None] + np.arange(per):
        for s, n in enumerate(number):
            _seed, outer, inner = layout.parts(int(n))
            after = moved(place, outer, folds)
            last = after if inner == folds else moved(after, inner, folds)
            whole, more = layout.copies(int(n))
            copies = np.where((numbers[:, s] == n) & trains[:, s] & enough[:, s] & (found[:, s] > 0), whole + (last < more), 0)
            mine = np.flatnonzero(copies)
            if len(mine):
                chosen = pick[:, s] & (copies > 0)[owner]
                held_by = found[mine, s]
                begin = np.cumsum(held_by) - held_by
                parts = -(-copies[mine] // COPIES)
                row = np.repeat(np.arange(len(mine)), parts)
                first = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * COPIES
                yield int(n), h[mine, s][row], x[mine][row], first, np.minimum(copies[mine][row] - first, COPIES), held_by[row], begin[row], near[chosen]


def _searched_in_sets(own: DataFrame, short: DataFrame, k: int) -> DataFrame:
    """Rows ``short`` with their nearest rows of the same set, by a search of these sets alone."""
    members = own.join(short.select("set").distinct(), "set", "left_semi")
    near = nearest_neighbours(members, "id", "x", k, group="set").join(short.select(F.col("id").alias("key")), "key", "left_semi")
    links = near.select(F.col("key").alias("id"), F.posexplode("neighbours").alias("at", "mate"))
    found = links.join(members.select(F.col("id").alias("mate"), F.col("x").alias("mate_x")), "mate")
    mates = found.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "mate_x"))), lambda m: m["mate_x"]).alias("mates"))
    return short.join(mates, "id")


def moved_column(place, fold, folds: int):
    """``moved`` as a column."""
    return F.floor(place / folds) * (folds - 1) + place % folds - (place % folds > fold).cast("int")


def made_up(h: np.ndarray, first: np.ndarray, copies: np.ndarray, x: np.ndarray, mates: Sequence[np.ndarray]) -> np.ndarray:
    """Points a hash-uniform part of the way from each row to hash-chosen mates: its copies from number ``first`` on.

    A copy depends on its row's hash and its own number only.
    """
    count = np.array([len(m) for m in mates])
    return _points(h, first, copies, x, count, np.cumsum(count) - count, np.concatenate(mates))


def _points(h: np.ndarray, first: np.ndarray, copies: np.ndarray, x: np.ndarray, count: np.ndarray, begin: np.ndarray, mates: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(h)), copies)
    number = 2 * (np.arange(len(owner)) - np.repeat(np.cumsum(copies) - copies, copies) + first[owner]).astype(np.int64)
    at = begin[owner] + (uniforms(h[owner], number) * count[owner]).astype(np.int64)
    return x[owner] + uniforms(h[owner], number + 1)[:, None] * (mates[at] - x[owner])


# ---- all models at once -------------------------------------------------------------------------
def _expit(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _with_one(x: pd.Series) -> np.ndarray:
    v = np.stack(x.to_numpy())
    return np.hstack([np.ones((len(v), 1)), v])


def _pieces(n: int) -> Iterator[slice]:
    return (slice(i, i + HELD_ROWS) for i in range(0, n, HELD_ROWS))


class _Sums:
    """Gradient and upper triangle of the curvature of many models."""

    def __init__(self, models: int, width: int):
        self.upper = np.triu_indices(width)
        self.values = np.zeros((models, width + len(self.upper[0])))

    def add(self, numbers: np.ndarray, x: np.ndarray, y, weights: np.ndarray, counts: np.ndarray) -> None:
        """Rows x under models ``numbers`` (columns of ``weights``); ``counts`` says how much a row counts in each."""
        if weights.shape[1] == 1:  # of one model the curvature is one product of matrices, without the products of every row
            p, n = _expit(x @ weights[:, 0]), counts[:, 0]
            self.values[numbers[0]] += np.append((n * (np.ravel(y) - p)) @ x, ((x * (n * p * (1 - p))[:, None]).T @ x)[self.upper])
            return
        p = _expit(x @ weights)
        products = x[:, self.upper[0]] * x[:, self.upper[1]]
        y = np.asarray(y, dtype=np.float64).reshape(-1, 1)
        self.values[numbers] += np.hstack([(counts * (y - p)).T @ x, (counts * p * (1 - p)).T @ products])

    def frame(self) -> pd.DataFrame:
        seen = np.flatnonzero(np.any(self.values != 0, axis=1))
        wide = self.values.shape[1]
        return pd.DataFrame({"model": np.repeat(seen, wide), "at": np.tile(np.arange(wide), len(seen)), "value": self.values[seen].ravel()})


SUMS = "model int, at int, value double"
SUMS_SCHEMA = pa.schema([("model", pa.int32()), ("at", pa.int32()), ("value", pa.float64())])


def _real_sums(layout: Layout, weights: np.ndarray, variants: Sequence[str]):
    """Sums over real rows; models are numbered variant by variant."""
    per_seed = layout.sets // layout.seeds
    ratio = np.array([layout.size(s, 0) / max(1, layout.size(s, 1)) for s in range(layout.sets)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = _Sums(*weights.shape)
        for batch in batches:
            for seed, part in batch.groupby("seed"):
                x, y, place = _with_one(part["x"]), part["y"].to_numpy(), part["place"].to_numpy()
                for piece in _pieces(len(part)):
                    inside = layout.trains(place[piece]).astype(np.float64)
                    for v, name in enumerate(variants):
                        numbers = np.arange(seed * per_seed, (seed + 1) * per_seed)
                        counts = inside * np.where(y[piece, None] == 1, ratio[numbers], 1.0) if name == "class_weights" else inside
                        sums.add(v * layout.sets + numbers, x[piece], y[piece], weights[v * layout.sets + numbers].T, counts)
        yield sums.frame()

    return run


def _made_up_sums(layout: Layout, weights: np.ndarray, variant: int, k: int):
    """Sums over made-up rows, drawn from stored minority rows (once a seed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(*weights.shape)
        for batch in batches:
            for number, h, x, first, copies, count, begin, mates in _by_set(batch, layout, k):
                _add_points(sums, variant * layout.sets + number, weights, h, first, copies, x, count, begin, mates)
        yield pa.RecordBatch.from_pandas(sums.frame(), schema=SUMS_SCHEMA, preserve_index=False)

    return run


def _add_points(sums: _Sums, model: int, weights: np.ndarray, h, first, copies, x, count, begin, mates) -> None:
    ends = np.flatnonzero(np.diff(np.cumsum(copies) // HELD_ROWS)) + 1
    for rows in np.split(np.arange(len(h)), ends):
        new = _points(h[rows], first[rows], copies[rows], x[rows], count[rows], begin[rows], mates)
        ones = np.hstack([np.ones((len(new), 1)), new])
        sums.add(np.array([model]), ones, 1.0, weights[[model]].T, np.ones((len(ones), 1)))


def _searched_sums(layout: Layout, weights: np.ndarray, variant: int):
    """Sums over made-up rows of the sets that were searched again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = _Sums(*weights.shape)
        for batch in batches:
            for number, part in batch.groupby("set"):
                h, first, copies = (part[c].to_numpy() for c in ("h", "first", "copies"))
                count = np.array([len(m) for m in part["mates"]])
                mates = np.concatenate([np.stack(m) for m in part["mates"]])
                _add_points(sums, variant * layout.sets + number, weights, h, first, copies, np.stack(part["x"].to_numpy()), count, np.cumsum(count) - count, mates)
        yield sums.frame()

    return run


def _totals(sums: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    for r in sums.groupBy("model", "at").agg(F.sum("value").alias("value")).collect():
        out[r["model"], r["at"]] = r["value"]
    return out


def _newton(step_sums, models: int, width: int, ridge: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Coefficients of all models; steps are cut to 8 so that no start goes astray."""
    a, b = np.triu_indices(width)
    weights = start
    for _ in range(STEPS):
        totals = _totals(step_sums(weights), (models, width + len(a)))
        curve = np.zeros((models, width, width))
        curve[:, a, b] = curve[:, b, a] = totals[:, width:]
        curve += np.diag(ridge + 1e-12)
        slope = totals[:, :width] - ridge * weights
        step = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
        step *= np.minimum(1.0, 8 / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-300))
        weights = weights + step
        if (slope * step).sum(axis=1).max() <= TOLERANCE:
            break
    return weights


def _whole_sums(ratio: float, weights: np.ndarray):
    """Sums over the rows of one seed, all of them training: unweighted, and with bads that count as much as goods."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = _Sums(*weights.shape)
        for batch in batches:
            if len(batch):
                x, y = _with_one(batch["x"]), batch["y"].to_numpy()
                for model, heavy in enumerate((1.0, ratio)):
                    sums.add(np.array([model]), x, y, weights[[model]].T, np.where(y == 1, heavy, 1.0)[:, None])
        yield sums.frame()

    return run


def fit_sets(rows: DataFrame, layout: Layout, width: int, variants: Sequence[str], neighbours: int = 5) -> np.ndarray:
    """Coefficients (intercept first) of every (variant, training set): logistic, C = 1 on the summed loss.

    Sets are large parts of the same rows, so their fits begin where the fit of all rows ends (made-up bads: where bads
    count as much as goods) and take few of the passes in which every set has its sums.
    """
    models, ridge = len(variants) * layout.sets, np.append(0.0, np.ones(width))
    stored, searched = nearest_in_sets(rows, layout, neighbours) if "smote" in variants else (None, None)
    narrow = rows.select("seed", "place", "y", "x")
    ratio = layout.totals[0] / max(1, layout.totals[1])
    whole = _newton(lambda w: narrow.filter("seed = 0").mapInPandas(_whole_sums(ratio, w), SUMS), 2, width + 1, ridge, np.zeros((2, width + 1)))

    def sums(weights: np.ndarray) -> DataFrame:
        out = narrow.mapInPandas(_real_sums(layout, weights, variants), SUMS)
        if stored is not None:
            out = out.unionByName(stored.mapInArrow(_made_up_sums(layout, weights, variants.index("smote"), neighbours), SUMS))
        if searched is not None:
            out = out.unionByName(searched.mapInPandas(_searched_sums(layout, weights, variants.index("smote")), SUMS))
        return out

    start = np.concatenate([np.tile(whole[int(v != "unweighted")], (layout.sets, 1)) for v in variants])
    weights = _newton(sums, models, width + 1, ridge, start)
    discard(*(t for t in (stored, searched) if t is not None))
    return weights


def fit_calibrators(rows: DataFrame, layout: Layout, weights: np.ndarray, variants: Sequence[str]) -> np.ndarray:
    """(offset, slope) by (variant, set): a sigmoid over the log-odds that a set's model gives its inner held-out rows.

    Targets are (bads + 1) / (bads + 2) and 1 / (goods + 2) of those rows, so every fit is finite.  Fits start at the
    constant rate.  Sets without an inner fold have none and stay (0, 0).
    """
    k, models = layout.folds, len(variants) * layout.sets
    targets, start = np.zeros((layout.sets, 2)), np.zeros((layout.sets, 2))
    for s in range(layout.sets):
        seed, outer, inner = layout.parts(s)
        if inner < k:
            goods, bads = (layout.size(layout.number(seed, outer, k), y) - layout.size(s, y) for y in (0, 1))
            targets[s] = 1 / (goods + 2), (bads + 1) / (bads + 2)
            start[s, 0] = np.log((bads + 1) / (goods + 1))

    def run_with(current: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = _Sums(models, 2)
            for batch in batches:
                for seed, part in batch.groupby("seed"):
                    x, y, place = _with_one(part["x"]), part["y"].to_numpy(), part["place"].to_numpy()
                    for o in range(k):
                        inner = np.where(place % k == o, -1, moved(place, o, k) % k)
                        for i in range(k):
                            mine, number = inner == i, layout.number(seed, o, i)
                            for v in range(len(variants) if mine.any() else 0):
                                m = np.array([v * layout.sets + number])
                                z = np.stack([np.ones(mine.sum()), x[mine] @ weights[m[0]]], axis=1)
                                sums.add(m, z, targets[number, y[mine]], current[m].T, np.ones((len(z), 1)))
            yield sums.frame()

        return run

    def sums(current: np.ndarray) -> DataFrame:
        return rows.select("seed", "place", "y", "x").mapInPandas(run_with(current), SUMS)

    return _newton(sums, models, 2, np.zeros(2), np.tile(start, (len(variants), 1)))


def _predictions(layout: Layout, weights: np.ndarray, calibrators: np.ndarray, variants: Sequence[str], seeds: Sequence[str]):
    k = layout.folds

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (seed, outer), part in batch.groupby([batch["seed"], batch["place"] % k]):
                x = _with_one(part["x"])
                for v, name in enumerate(variants):
                    first = v * layout.sets + layout.number(seed, outer, 0)
                    inner = slice(first, first + k)
                    each = _expit(calibrators[inner, 0] + calibrators[inner, 1] * (x @ weights[inner].T))
                    for kind, p in (("raw", _expit(x @ weights[first + k])), ("calibrated", each.mean(axis=1))):
                        yield pd.DataFrame({"variant": name, "kind": kind, "seed": seeds[seed], "fold": int(outer), "key": part["key"].to_numpy(),
                                            "y": part["y"].to_numpy(), "p": p})

    return run


def placed_rows(df: DataFrame, y: str, key: str, preparation: Preparation, seeds: Sequence[str]) -> DataFrame:
    """(seed, place, key, y, x) of all rows with a key and an outcome, written once."""
    x = F.array(*[e.cast("double") for _n, _f, e in preparation.columns])
    narrow = df.filter(F.col(y).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(y).cast("int").alias("y"), x.alias("x"))
    return write_scratch(class_places(write_scratch(narrow, "prepared"), "y", "key", seeds), "places")


def stratified_kfold(df: DataFrame, y: str, key: str, preparation: Preparation, folds: int = 5, seeds: Sequence[str] = S.FOLD_SEEDS,
                     variants: Sequence[str] = VARIANTS) -> DataFrame:
    """(variant, kind, seed, fold, key, y, p): out-of-fold probabilities of every row, "raw" and "calibrated".

    Raw ones come from the model fitted outside the row's fold.  Calibrated ones are the mean of ``folds`` models,
    each fitted outside one inner fold as well and put through a sigmoid fitted on that inner fold, so that neither a
    model nor a calibrator has seen the row, and no calibrator rests on rows its model has seen.  ``preparation`` is
    learned without outcomes.  Variants: "unweighted"; "class_weights" (bads count as much as goods); "smote" (made-up
    bads until the classes are equal, made from the training rows of each set only).  Keys are distinct; rows without
    outcome or key are left out; an empty table gives no rows.  Each class needs two rows a fold at least.
    """
    unknown = [v for v in variants if v not in VARIANTS]
    if unknown:
        raise ValueError(f"unknown variants {unknown}")
    rows = placed_rows(df, y, key, preparation, seeds)
    kind = f"variant string, kind string, seed string, fold int, key {dict(rows.dtypes)['key']}, y int, p double"
    counts: Mapping[int, int] = {r["y"]: r["n"] for r in rows.filter("seed = 0").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return df.sparkSession.createDataFrame([], kind)
    if min(counts.get(0, 0), counts.get(1, 0)) < 2 * folds:
        raise ValueError(f"{folds} folds need at least {2 * folds} rows of each class")
    layout = Layout(len(seeds), folds, (counts[0], counts[1]))
    weights = fit_sets(rows, layout, len(preparation.columns), list(variants))
    calibrators = fit_calibrators(rows, layout, weights, list(variants))
    return rows.mapInPandas(_predictions(layout, weights, calibrators, list(variants), list(seeds)), kind)
