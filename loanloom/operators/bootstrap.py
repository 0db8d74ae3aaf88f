"""Paired bootstrap intervals from weighted cells.

No table of cells times resamples exists anywhere.  A cell's weights follow from its hash and the resample's number, so
every task draws the same weights again when it needs them, and hands on sums for all resamples: first the totals of
each group, then, of each arm and range of values, what the range adds to every measure.  Ranks need order only inside a
range; the ranges of an arm then follow one another by their totals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.operators.metrics import percentile_ci
from loanloom.session import write_scratch

#: Cells of a range (on average) and of a slice of one value; resamples summed together; weights drawn at a time.
RANGE_CELLS, CHUNK, DRAWN = 20_000, 250, 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4096)
def poisson_steps(n: int) -> tuple[int, np.ndarray]:
    """First value and cumulative probabilities of Poisson(n), but for tails below 1e-20."""
    wide = int(12 * n ** 0.5) + 30
    first = max(0, n - wide)
    k = np.arange(first, n + wide, dtype=np.float64)
    logs = k * np.log(n) - n - np.array([lgamma(x + 1) for x in k])
    return first, np.cumsum(np.exp(logs))


def uniforms(h: np.ndarray, number: np.ndarray) -> np.ndarray:
    """53 hashed bits in [0, 1) of each hash and number."""
    z = h.astype(np.uint64) + _STEP * (number + 1).astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53


def poisson_weights(h: np.ndarray, n: np.ndarray, first: int, last: int) -> np.ndarray:
    """Weights of cells (hash, rows) in the resamples first to last - 1: Poisson(rows), by inversion of 53 hashed bits.

    They depend on the cell and the resample's number only, so any task gets the same ones.
    """
    u = uniforms(h[:, None], np.arange(first, last))
    out = np.empty(u.shape, np.int64)
    for size in np.unique(n):
        rows = n == size
        start, steps = poisson_steps(int(size))
        out[rows] = start + np.searchsorted(steps, u[rows], side="right")
    return out


def _blocks(n: int, width: int) -> Iterator[slice]:
    step = max(1, DRAWN // width)
    return (slice(i, i + step) for i in range(0, n, step))


def _chunks(resamples: int) -> list[tuple[int, int]]:
    return [(a, min(a + CHUNK, resamples)) for a in range(0, resamples, CHUNK)]


def _totals(by: Sequence[str], resamples: int):
    """Weight of goods and bads of every group, summed in the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for group, part in batch.groupby("grp", sort=False):
                total = sums.setdefault(group, np.zeros((2, resamples), np.int64))
                h, n, y = (part[c].to_numpy() for c in ("h", "n", "y"))
                for block in _blocks(len(part), resamples):
                    w = poisson_weights(h[block], n[block], 0, resamples)
                    bad = y[block].astype(np.int64) @ w
                    total += np.stack([w.sum(axis=0) - bad, bad])
            if len(sums) * resamples > 4 * DRAWN:
                yield from _total_rows(sums)
                sums = {}
        yield from _total_rows(sums)

    def _total_rows(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        rows = [(g, a, t[0, a:b].tobytes(), t[1, a:b].tobytes()) for g, t in sums.items() for a, b in _chunks(resamples)]
        if rows:
            yield pd.DataFrame(rows, columns=["grp", "chunk", "good", "bad"])

    return run


def _add_totals(part: pd.DataFrame) -> pd.DataFrame:
    sums = [sum(np.frombuffer(x, np.int64) for x in part[c]).tobytes() for c in ("good", "bad")]
    return pd.DataFrame([(part["grp"].iloc[0], part["chunk"].iloc[0], *sums)], columns=["grp", "chunk", "good", "bad"])


def _range_sums(part: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
    """What one range (or a slice of one value) adds, for every resample of each chunk.

    good, bad: weights; pairs: bads above goods inside the range, ties by half; gap: largest lead of the cumulative
    share of goods before a value over that of bads, counted from the range's start; level and square: sums of x and
    of the squared errors.
    """
    out = []
    if len(part) and len(totals):
        part = part.sort_values("x", kind="stable")
        x, h, n = (part[c].to_numpy() for c in ("x", "h", "n"))
        y = part["y"].to_numpy().astype(np.int64)
        edges = np.append(np.flatnonzero(np.diff(x, prepend=np.nan) != 0), len(x))  # where values begin
        for _, t in totals.iterrows():
            all_good, all_bad = (np.frombuffer(t[c], np.int64).astype(np.float64) for c in ("good", "bad"))
            width = len(all_good)
            good, bad, pairs, level, square = np.zeros((5, width))
            gap = np.full(width, -np.inf)
            at = 0
            while at < len(edges) - 1:
                stop = max(at + 1, int(np.searchsorted(edges, edges[at] + max(1, DRAWN // width), "right")) - 1)
                rows = slice(edges[at], edges[stop])
                w = poisson_weights(h[rows], n[rows], t["chunk"], t["chunk"] + width)
                starts = edges[at:stop] - edges[at]
                bads = np.add.reduceat(w * y[rows][:, None], starts, axis=0).astype(np.float64)
                goods = np.add.reduceat(w, starts, axis=0) - bads
                good_before = good + np.cumsum(goods, axis=0) - goods
                bad_before = bad + np.cumsum(bads, axis=0) - bads
                pairs += (bads * (good_before + 0.5 * goods)).sum(axis=0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gap = np.fmax(gap, (good_before / all_good - bad_before / all_bad).max(axis=0))
                value = x[edges[at:stop]][:, None]
                level += ((goods + bads) * value).sum(axis=0)
                square += (bads * (1 - value) ** 2 + goods * value ** 2).sum(axis=0)
                good, bad = good + goods.sum(axis=0), bad + bads.sum(axis=0)
                at = stop
            key = part.iloc[0]
            out.append((key["grp"], key["arm"], int(t["chunk"]), int(key["place"]), bool(key["single"]), *(v.tobytes() for v in (good, bad, pairs, gap, level, square))))
    return pd.DataFrame(out, columns=["grp", "arm", "chunk", "place", "single", "good", "bad", "pairs", "gap", "level", "square"])


def _measures(part: pd.DataFrame) -> pd.DataFrame:
    """The measures of one arm in a chunk of resamples, its ranges laid end to end."""
    part = part.sort_values("place", kind="stable")
    place = part["place"].to_numpy()
    first = np.flatnonzero(np.diff(place, prepend=-1))
    v = {c: np.stack([np.frombuffer(b, np.float64) for b in part[c]]) for c in ("good", "bad", "pairs", "gap", "level", "square")}
    joined = {c: np.add.reduceat(v[c], first, axis=0) for c in ("good", "bad", "pairs", "level", "square")}
    single = part["single"].to_numpy()[first][:, None]
    good, bad = joined["good"], joined["bad"]
    inside = np.where(single, 0.5 * good * bad, joined["pairs"])  # slices of one value are tied with each other
    good_before, bad_before = np.cumsum(good, axis=0) - good, np.cumsum(bad, axis=0) - bad
    all_good, all_bad = good.sum(axis=0), bad.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gini = 2 * (inside + bad * good_before).sum(axis=0) / (all_good * all_bad) - 1
        lead = np.where(single, 0.0, np.maximum.reduceat(v["gap"], first, axis=0))
        ks = np.fmax((good_before / all_good - bad_before / all_bad + lead).max(axis=0), 0.0)
        brier = joined["square"].sum(axis=0) / (all_good + all_bad)
        ratio = np.where(all_bad > 0, joined["level"].sum(axis=0) / all_bad, np.nan)
    key, found = part.iloc[0], (all_good > 0) & (all_bad > 0)
    return pd.DataFrame({"grp": key["grp"], "arm": key["arm"], "resample": np.arange(len(gini)) + key["chunk"] + 1, "gini": np.where(found, gini, np.nan),
                         "ks": np.where(found, ks, 0.0), "brier": brier, "pred_over_obs": ratio})


def paired_bootstrap(df: DataFrame, y: str, arms: Sequence[str], resamples: int, seed: int = 42, by: Sequence[str] = (), range_cells: int = RANGE_CELLS) -> DataFrame:
    """(by, resample, arm) -> gini, ks, brier and predicted/observed of every resample, all arms on the same resampled rows.

    Every row gets an independent Poisson(1) weight per resample.  Rows that agree on outcome and on all arms' PDs
    form one cell, whose total weight is Poisson(n).  Weights depend on the cell's content only, never on the
    partitioning.  Rows without outcome or without some arm's PD are left out of all arms.  A resample without goods or
    without bads has no Gini, one without bads no predicted/observed.

    Cells are shuffled once per arm, into value ranges bounded in size; a value with more cells than a range holds is
    cut into slices, as nothing inside it needs order.  What goes on is one row of sums per range and ``CHUNK`` resamples.
    """
    whole = df.select(*by, F.col(y).cast("int").alias("y"), *[F.col(a).cast("double").alias(f"arm_{i}") for i, a in enumerate(arms)]).dropna(
        subset=["y", *[f"arm_{i}" for i in range(len(arms))]])
    group = F.to_json(F.struct(*by)) if by else F.lit("{}")
    cells = whole.groupBy(*whole.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("grp", group)
    cells = cells.withColumn("h", F.xxhash64(F.lit(seed), "grp", "y", *[f"arm_{i}" for i in range(len(arms))]))
    cells = write_scratch(cells, "cells")
    totals = cells.select("grp", "h", "n", "y").mapInPandas(_totals(by, resamples), "grp string, chunk int, good binary, bad binary")
    totals = write_scratch(totals.groupBy("grp", "chunk").applyInPandas(_add_totals, totals.schema), "totals")

    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"arm_{i}").alias("x")) for i, a in enumerate(arms)]))
    long = cells.select("grp", "y", "n", "h", each.alias("e")).select("grp", "y", "n", "h", "e.*")
    ranges = max(1, -(-cells.count() // range_cells))
    points = [i / ranges for i in range(1, ranges)] or [0.5]
    bounds = long.groupBy("grp", "arm").agg(F.array_distinct(F.percentile_approx("x", points, F.lit(max(10_000, 10 * ranges)))).alias("bounds"))
    below = F.size(F.filter("bounds", lambda b: b < F.col("x")))
    single = F.array_contains("bounds", F.col("x"))
    placed = long.join(bounds, ["grp", "arm"]).withColumn("single", single).withColumn("place", 2 * below + single.cast("int")).drop("bounds")
    sizes = placed.groupBy("grp", "arm", "place").agg(F.count(F.lit(1)).alias("held"))
    slices = F.when(F.col("single"), F.ceil(F.col("held") / range_cells)).otherwise(1)
    placed = placed.join(sizes, ["grp", "arm", "place"]).withColumn("slice", F.pmod(F.col("h"), slices)).drop("held")

    keys = ["grp", "arm", "place", "slice"]
    placed = write_scratch(placed, "placed")
    sent = placed.groupBy(*[F.col(k).alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("held")).drop("held")
    sent = sent.join(totals, "grp").select(*[F.col(c).alias(c) for c in (*keys, "chunk", "good", "bad")])  # the group's totals, for each of its ranges
    kind = "grp string, arm string, chunk int, place int, single boolean, good binary, bad binary, pairs binary, gap binary, level binary, square binary"
    sums = placed.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(_range_sums, kind)
    found = sums.groupBy("grp", "arm", "chunk").applyInPandas(_measures, "grp string, arm string, resample int, gini double, ks double, brier double, pred_over_obs double")
    names = cells.select("grp", *by).distinct()
    measures = [F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in ("gini", "ks", "brier", "pred_over_obs")]
    return found.join(names, "grp").select(*by, "resample", "arm", *measures)


def interval_table(replicates: DataFrame, measures: Sequence[str] = ("gini", "ks", "brier", "pred_over_obs"), by: Sequence[str] = ("arm",)) -> DataFrame:
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures]))
    return percentile_ci(replicates.select(*by, long.alias("m")).select(*by, "m.*"), "value", [*by, "measure"])


def gini_differences(replicates: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """(by, resample, pair) -> difference of the two arms in the same resample."""
    value = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("gini")))
    wide = replicates.groupBy(*by, "resample").agg(*[(value(a) - value(c)).alias(f"d{i}") for i, (a, c) in enumerate(pairs)])
    long = F.explode(F.array(*[F.struct(F.lit(f"{a} minus {c}").alias("pair"), F.col(f"d{i}").alias("difference")) for i, (a, c) in enumerate(pairs)]))
    return wide.select(*by, "resample", long.alias("d")).select(*by, "resample", "d.*")


def gini_difference_ci(replicates: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Interval of every difference; significant when it excludes zero."""
    ci = percentile_ci(gini_differences(replicates, pairs, by), "difference", [*by, "pair"])
    return ci.withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def mean_difference_verdict(replicates: DataFrame, pairs: Sequence[tuple[str, str]], vintage: str, margin: float = S.NON_INFERIORITY_MARGIN) -> DataFrame:
    """Mean difference over vintages per resample -> interval, non-inferior and superior flags."""
    means = gini_differences(replicates, pairs, [vintage]).groupBy("pair", "resample").agg(F.avg("difference").alias("difference"))
    point = means.groupBy("pair").agg(F.avg("difference").alias("mean_difference"))
    return percentile_ci(means, "difference", ["pair"]).join(point, "pair").withColumn(
        "non_inferior", F.col("low") > -margin).withColumn("superior", F.col("low") > 0)
