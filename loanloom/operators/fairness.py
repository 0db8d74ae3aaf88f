"""Approval and honesty of the predicted risk, group by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions.stats import safe_ratio
from loanloom.functions.typing import fill_missing_level


def top_n_plus_other(df: DataFrame, column: str, n: int = S.TOP_STATES, other: str = "other states", by: Sequence[str] = ()) -> DataFrame:
    """Keep the ``n`` largest groups of ``column`` (per set), rename the rest.

    The kept names come back as one small array per set, joined on the set keys.
    """
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), F.asc(column)))
    top = counts.withColumn("_place", place).filter(F.col("_place") <= n).groupBy(*by).agg(F.collect_list(column).alias("_top"))
    tagged = df.join(top, list(by)) if by else df.withColumn("_top", top.scalar())
    return tagged.withColumn(column, F.when(F.array_contains("_top", F.col(column)), F.col(column)).otherwise(other)).drop("_top")


def fairness_slice(df: DataFrame, threshold: float, variables: Sequence[str] = tuple(S.SLICE_VARIABLES), by: Sequence[str] = (),
                   min_loans: int = S.MIN_SLICE_LOANS) -> DataFrame:
    """One row per (set, variable, group); all variables share one aggregation."""
    narrow = df.select(*by, "pd", "y", *[fill_missing_level(F.col(v)).alias(v) for v in variables])
    if "state" in variables:
        narrow = top_n_plus_other(narrow, "state", by=by)
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("group")) for v in variables])).alias("s")
    keys = [*by, "variable", "group"]
    g = narrow.select(*by, "pd", "y", pairs).select(*by, "pd", "y", "s.*").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("loans"), F.sum(F.col("y").cast("bigint")).alias("defaults"), F.sum("pd").alias("expected"),
        F.avg((F.col("pd") <= threshold).cast("double")).alias("approval_rate"), F.avg("pd").alias("mean_pd"))
    g = g.filter(F.col("loans") >= min_loans)
    peers = Window.partitionBy(*by, "variable")
    refusal = 1 - F.col("approval_rate")
    defaults, expected = F.col("defaults"), F.col("expected")
    half = 1.96 * F.sqrt(F.greatest(defaults, F.lit(1)))
    enough = defaults >= S.MIN_DEFAULTS_CI
    g = (g.withColumn("default_rate", defaults / F.col("loans"))
         .withColumn("adverse_impact_ratio", F.col("approval_rate") / F.nullif(F.max("approval_rate").over(peers), F.lit(0.0)))
         .withColumn("refusal_ratio_vs_lowest", refusal / F.greatest(F.min(refusal).over(peers), F.lit(0.001)))
         .withColumn("pred_over_obs", safe_ratio(expected, defaults))
         .withColumn("ratio_low", F.when(enough, expected / (defaults + half)))
         .withColumn("ratio_high", F.when(enough, expected / F.greatest(defaults - half, F.lit(0.5)))))
    return (g.withColumn("flag_approval", F.coalesce(F.col("adverse_impact_ratio") < 0.80, F.lit(False)))
            .withColumn("flag_calibration", enough & ((F.col("ratio_low") > 1) | (F.col("ratio_high") < 1))).drop("expected"))


def group_calibration_spread(slices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest over smallest predicted/observed ratio among groups with enough defaults; NULL below two groups."""
    ok = slices.filter(F.col("defaults") >= S.MIN_DEFAULTS_CI)
    return ok.groupBy(*by, "variable").agg(
        F.when(F.count(F.lit(1)) >= 2, safe_ratio(F.max("pred_over_obs"), F.min("pred_over_obs"))).alias("spread"))


def spread_comparison(spreads: DataFrame, arm: str, new: str, old: str, needed: int = 4) -> DataFrame:
    """In how many variables the new arm has the smaller spread."""
    wide = spreads.groupBy("variable").agg(F.max(F.when(F.col(arm) == new, F.col("spread"))).alias("new"),
                                           F.max(F.when(F.col(arm) == old, F.col("spread"))).alias("old"))
    better = F.coalesce(F.col("new") < F.col("old"), F.lit(False))
    return wide.agg(F.count_if(better).alias("better"), F.count(F.lit(1)).alias("variables")).withColumn("needed", F.lit(needed)) \
        .withColumn("met", F.col("better") >= needed)
