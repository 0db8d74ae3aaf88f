"""Global running sums and equal-count bins without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom.functions import hashing
from loanloom.session import write_scratch

BUCKETS = 64


def score_cells(df: DataFrame, score: str, y: str | None, by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, distinct score): n and, with ``y``, bad.  Ties and hot scores collapse map-side."""
    sums = [F.count(F.lit(1)).alias("n")]
    if y is not None:
        sums.append(F.sum(F.col(y).cast("bigint")).alias("bad"))
    return df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("x")).agg(*sums)


def with_bucket(cells: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Tag every cell with a value range of roughly equal cell count.

    The bounds are one array of ``buckets`` - 1 numbers (a scalar subquery).  They only decide how work is spread:
    equal values always share a bucket and buckets are ordered, so the results below do not depend on them.
    """
    points = [i / buckets for i in range(1, buckets)]
    bounds = cells.agg(F.percentile_approx("x", points, F.lit(1000)))
    return (cells.withColumn("_bounds", bounds.scalar())
            .withColumn("bucket", F.size(F.filter("_bounds", lambda b: b < F.col("x")))).drop("_bounds"))


def running_before(cells: DataFrame, sums: Sequence[str], by: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Ascending-x running sums *before* each cell (``before_*``) and group totals (``total_*``).

    Each value bucket is ordered on its own; the offsets of the buckets come from at most ``buckets`` rows per group.
    The cells are written first: bounds, offsets and rows then read them and not the table they were counted from.
    """
    cells = write_scratch(cells, "cells")
    tagged = with_bucket(cells, buckets)
    keys = [*by, "bucket"]
    per_bucket = tagged.groupBy(*keys).agg(*[F.sum(s).alias(f"in_{s}") for s in sums])
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        *[F.coalesce(F.sum(f"in_{s}").over(earlier), F.lit(0)).alias(f"offset_{s}") for s in sums],
        *[F.sum(f"in_{s}").over(whole).alias(f"total_{s}") for s in sums])
    on = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    cond = on[0]
    for extra in on[1:]:
        cond = cond & extra
    inside = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    return (tagged.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"inside_{s}") for s in sums])
            .join(offsets, cond)
            .select(*cells.columns, *[(F.col(f"offset_{s}") + F.col(f"inside_{s}")).alias(f"before_{s}") for s in sums],
                    *[f"total_{s}" for s in sums]))


def bin_cuts(df: DataFrame, score: str, n_bins: int) -> DataFrame:
    """One row: the array of at most ``n_bins`` - 1 cuts (bin, score, how many tied rows stay below, rows tied).

    Bin k of N ranked rows ends at rank floor((k+1)(N-1)/n_bins) + 1, the interval rule of equal-count quantile cuts.
    """
    cells = running_before(score_cells(df, score, None), ["n"])
    def last_rank(k):
        return F.floor((k + 1) * (F.col("total_n") - 1) / n_bins) + 1

    ends_here = F.filter(F.sequence(F.lit(0), F.lit(max(n_bins - 2, 0))), lambda k: (F.col("before_n") < last_rank(k))
                         & (last_rank(k) <= F.col("before_n") + F.col("n")))
    holding = cells.withColumn("k", F.explode(ends_here))
    cut = F.struct(F.col("k"), F.col("x"), (last_rank(F.col("k")) - F.col("before_n")).alias("stay"), F.col("n").alias("tied"))
    return holding.agg(F.sort_array(F.collect_list(cut)).alias("cuts"))


def equal_size_bins(df: DataFrame, score: str, key: str, n_bins: int, out: str = "bin", salt: str = "tie") -> DataFrame:
    """Add the equal-count bin (0-based) of every row; ties are ordered by a hash of the key, then the key.

    Rows are compared with the few cut scores.  Only rows tied with a score that straddles a cut need a rank, and that
    rank is computed in hash slices of the tied group, so a score shared by a third of the rows is no hot spot.
    """
    x, cuts = F.col(score).cast("double"), F.col("_cuts")
    below = F.size(F.filter(cuts, lambda c: c["x"] < x))
    straddled = F.exists(cuts, lambda c: (c["x"] == x) & (c["stay"] < c["tied"]))
    base = df.filter(F.col(score).isNotNull()).withColumn("_cuts", bin_cuts(df, score, n_bins).scalar())
    calm = base.filter(~straddled).withColumn(out, below).drop("_cuts")

    slices = 64
    u = hashing.uniform32(F.col(key), salt)
    tied = base.filter(straddled).withColumn("_u", u).withColumn("_slice", F.floor(F.col("_u") * slices / hashing.SPAN)) \
        .withColumn("_x", x)
    counts = tied.groupBy("_x", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_x").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_x", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_x", "_slice").orderBy("_u", key)) + F.col("_before")
    ranked = tied.join(offsets, ["_x", "_slice"]).withColumn("_rank", rank)
    passed = F.size(F.filter(cuts, lambda c: (c["x"] == x) & (F.col("_rank") > c["stay"])))
    return calm.unionByName(ranked.withColumn(out, below + passed).select(*df.columns, out))


def hash_cut(df: DataFrame, key: str, seed: str, quota, by: Sequence[str] = (), slices: int = 1024) -> DataFrame:
    """The (hash, key) position up to which exactly ``quota`` rows of each group lie in hash order.

    ``quota`` is a column over ``total`` (rows of the group).  Whole hash slices are counted; only the slice holding
    the cut is ranked, so no group is ordered as a whole.  A quota of zero gives a NULL cut.
    """
    base = df.select(*by, F.col(key).alias("k"), hashing.uniform32(F.col(key), seed).alias("u"))
    base = base.withColumn("slice", F.floor(F.col("u") * slices / hashing.SPAN))
    counts = base.groupBy(*by, "slice").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("n").over(group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("before", before).withColumn("total", F.sum("n").over(group)).withColumn(
        "quota", F.least(quota.cast("bigint"), F.col("total")))
    edge = placed.filter((F.col("before") < F.col("quota")) & (F.col("quota") <= F.col("before") + F.col("n")))
    take = edge.select(*by, "slice", (F.col("quota") - F.col("before")).alias("take"))
    rank = F.row_number().over(Window.partitionBy(*by, "slice").orderBy("u", "k"))
    inside = base.join(take, [*by, "slice"]).withColumn("rank", rank).filter(F.col("rank") <= F.col("take"))
    return inside.groupBy(*by).agg(F.max(F.struct("u", "k")).alias("cut"))


def within_cut(key: str, seed: str, cut):
    """Whether a row lies at or before the cut."""
    place = F.struct(hashing.uniform32(F.col(key), seed).alias("u"), F.col(key).alias("k"))
    return F.coalesce(place <= cut, F.lit(False))
