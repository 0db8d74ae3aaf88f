"""Exact quantiles of groups by narrowing: a range histogram, then only the ranges that hold the wanted ranks.

Equal values are counted first.  A group with more distinct values than ``LIMIT`` is cut into ranges; the counts of the
ranges tell which of them hold the ranks asked for, and only their values go into the next round, until every part is
small enough to be put in order.  So no group is ever buffered or ordered as a whole, and the approximate bounds decide
only how fast it narrows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom.session import write_scratch

#: Distinct values that are put in order together, and ranges of a part in one round.
LIMIT, RANGES = 100_000, 256


def _narrowed(values: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts cut into ranges: the values of the ranges that hold a wanted rank, and the ranks counted from their starts."""
    points = [i / RANGES for i in range(1, RANGES)]
    bounds = values.groupBy("g", "part").agg(F.array_distinct(F.percentile_approx("x", points, F.lit(20 * RANGES))).alias("bounds"))
    below = F.size(F.filter("bounds", lambda b: b < F.col("x")))
    placed = values.join(bounds, ["g", "part"]).select("g", "part", below.cast("bigint").alias("range"), "x", "n")
    placed = write_scratch(placed, "placed")
    counts = placed.groupBy("g", "part", "range").agg(F.sum("n").alias("held"))
    earlier = Window.partitionBy("g", "part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    holds = (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("held"))
    child = F.col("part") * RANGES + F.col("range")
    found = asks.join(counts, ["g", "part"]).filter(holds).select("g", child.alias("part"), (F.col("rank") - F.col("before")).alias("rank"), "asked")
    found = write_scratch(found, "asks")
    kept = placed.withColumn("part", child).join(found.select("g", "part").distinct(), ["g", "part"], "left_semi")
    return write_scratch(kept.select("g", "part", "x", "n"), "values"), found


def cell_quantiles(cells: DataFrame, by: Sequence[str], shares: Sequence[float], limit: int = LIMIT) -> DataFrame:
    """(by, quantiles): the quantiles of x in each group of (by, x, n) cells with distinct x, ranks interpolated linearly.

    Groups may have NULL keys; every group of the cells has a row.  A share of 0.5 is the median with its middle values
    averaged.
    """
    g = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    values = write_scratch(cells.select(g.alias("g"), F.lit(0).cast("bigint").alias("part"), F.col("x").cast("double").alias("x"), F.col("n").cast("bigint").alias("n")), "values")
    totals = values.groupBy("g").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))
    totals = write_scratch(totals, "totals")
    ends = F.array(*[f(F.lit(float(s)) * (F.col("total") - 1)).cast("bigint") for s in shares for f in (F.floor, F.ceil)])
    asks = totals.select("g", F.lit(0).cast("bigint").alias("part"), F.explode(F.array_distinct(ends)).alias("rank")).withColumn("asked", F.col("rank"))
    most = totals.agg(F.max("distinct")).first()[0] or 0
    while most > limit:
        values, asks = _narrowed(values, asks)
        after = values.groupBy("g", "part").agg(F.count(F.lit(1)).alias("distinct")).agg(F.max("distinct")).first()[0] or 0
        if after >= most:
            break  # values too close for the bounds to part them: put in order as they are
        most = after
    along = Window.partitionBy("g", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = values.withColumn("until", F.sum("n").over(along))
    wanted = asks.groupBy("g", "part").agg(F.collect_list(F.struct("rank", "asked")).alias("ranks"))  # two for a share at most
    hits = F.filter("ranks", lambda r: (F.col("until") - F.col("n") <= r["rank"]) & (r["rank"] < F.col("until")))
    picked = ordered.join(wanted, ["g", "part"]).select("g", "x", F.explode(hits).alias("hit"))
    at = picked.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct(F.col("hit.asked"), F.col("x")))).alias("at")).join(totals, "g")

    def quantile(share: float):
        position = F.lit(float(share)) * (F.col("total") - 1)
        low, high = (F.col("at")[f(position).cast("bigint")] for f in (F.floor, F.ceil))
        return low + (high - low) * (position - F.floor(position))

    return at.select(*[F.col("g")[c].alias(c) for c in by], F.array(*[quantile(s) for s in shares]).alias("quantiles"))


def group_quantiles(df: DataFrame, value: str, by: Sequence[str], shares: Sequence[float], limit: int = LIMIT) -> DataFrame:
    """(by, quantiles) of a column; NULL and NaN are left out, and so are groups without any value."""
    x = F.col(value).cast("double")
    cells = df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(*by, (x + F.lit(0.0)).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return cell_quantiles(cells, by, shares, limit)


def exact_medians(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, median) of x per group from (by, x, n) cells."""
    return cell_quantiles(cells, by, [0.5]).select(*by, F.col("quantiles")[0].alias("median"))
