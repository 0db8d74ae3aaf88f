"""Join, exclusions, rate spread and splits: staged tables -> feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions import hashing, typing as T

SPREAD_KEYS = ("vintage_year", "vintage_quarter", "long_term")


def join_labels(orig: DataFrame, label: DataFrame) -> DataFrame:
    """Inner join on the loan key; the label side arrives already hashed by it."""
    return orig.join(label, "loan_seq")


def keep_condition() -> Column:
    return ~F.col("relief_refi") & ~F.col("is_seasoned_or_modified") & F.col("observable_24m")


def exclusion_filter(joined: DataFrame) -> DataFrame:
    return joined.filter(keep_condition())


def exclusion_waterfall(joined: DataFrame) -> DataFrame:
    """Ordered exclusions per vintage.

    Rows whose flags are NULL meet none of the conditions; ``unaccounted`` shows how many there are.
    """
    relief, seasoned, seen = F.col("relief_refi"), F.col("is_seasoned_or_modified"), F.col("observable_24m")
    steps = {"removed_relief_refi": relief,
             "removed_seasoned_or_modified": ~relief & seasoned,
             "removed_not_observable": ~relief & ~seasoned & ~seen,
             "kept": keep_condition()}
    counted = joined.groupBy("vintage_year").agg(F.count(F.lit(1)).alias("start"),
                                                 *[F.count_if(cond).alias(name) for name, cond in steps.items()])
    return counted.withColumn("unaccounted", F.col("start") - sum((F.col(c) for c in steps), F.lit(0)))


def group_medians(df: DataFrame, value: str, keys: tuple[str, ...], out: str) -> DataFrame:
    """Exact medians of values with few distinct ones (rates in basis points): the values are counted before they are put
    in order, and no group is buffered.  For values of any domain see ``selection.group_quantiles``."""
    cells = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    up, down = (Window.partitionBy(*keys).orderBy(o) for o in (F.asc("_x"), F.desc("_x")))
    until, since = F.sum("_n").over(up), F.sum("_n").over(down)
    # a value is in the middle if at least half of the rows lie on either side up to and with it
    middle = cells.withColumn("_until", until).withColumn("_since", since).filter((2 * F.col("_until") >= F.col("_until") + F.col("_since") - F.col("_n"))
                                                                                  & (2 * F.col("_since") >= F.col("_until") + F.col("_since") - F.col("_n")))
    return middle.groupBy(*keys).agg(((F.min("_x") + F.max("_x")) / 2).alias(out))


def join_nullsafe(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Left join where NULL keys match NULL keys.  ``right`` holds a row for each group of keys at most and is broadcast, so
    that ``left`` is not shuffled to a few hot keys."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    cond = on[0]
    for extra in on[1:]:
        cond = cond & extra
    return left.join(F.broadcast(renamed), cond, "left").drop(*[f"_r_{k}" for k in keys])


def rate_spread(kept: DataFrame) -> DataFrame:
    """Rate minus the median rate of kept loans of the same vintage quarter and term class.

    Aggregate-then-join instead of a window: a window would pull each of the few groups into one task.
    """
    tagged = kept.withColumn("long_term", T.term_class(F.col("orig_term")))
    medians = group_medians(tagged, "int_rate", SPREAD_KEYS, "median_rate")
    return (join_nullsafe(tagged, medians, SPREAD_KEYS)
            .withColumn("rate_spread", F.col("int_rate") - F.col("median_rate"))
            .drop("median_rate", "long_term"))


def rate_spread_window(kept: DataFrame) -> DataFrame:
    """The same spread as one window expression, for small inputs."""
    w = Window.partitionBy("vintage_year", "vintage_quarter", T.term_class(F.col("orig_term")))
    return kept.withColumn("rate_spread", F.col("int_rate") - F.percentile("int_rate", F.lit(0.5)).over(w))


def build_features(kept: DataFrame, dev_max: int, oot_1_max: int, key: Column | None = None) -> DataFrame:
    """Development feature table."""
    split = hashing.split_name(F.col("loan_seq") if key is None else key, F.col("vintage_year"), dev_max, oot_1_max)
    return rate_spread(kept).select(*S.META, *S.FEATURES, *S.LABELS, split.alias("split"))


def build_fresh(kept: DataFrame) -> DataFrame:
    """Holdout feature table: one split per vintage plus the borrower flag."""
    return rate_spread(kept).select(
        *S.META, *S.FEATURES, T.several_borrowers(F.col("n_borrowers")).alias("several_borrowers"), *S.LABELS,
        hashing.fresh_split_name(F.col("vintage_year")).alias("split"))


def split_summary(features: DataFrame, *keys: str) -> DataFrame:
    """Loans, defaults and default percentage per split (or any other keys)."""
    return features.groupBy(*(keys or ("split",))).agg(
        F.count(F.lit(1)).alias("loans"), F.sum(S.TARGET).cast("bigint").alias("defaults"),
        F.round(100.0 * F.avg(S.TARGET), 2).alias("default_rate_pct"))


def split_share(features: DataFrame) -> DataFrame:
    """Share of every split in the total; the window runs over the few aggregated rows."""
    counts = features.groupBy("split").agg(F.count(F.lit(1)).alias("loans"))
    total = F.sum("loans").over(Window.partitionBy())
    return counts.withColumn("pct", F.round(100.0 * F.col("loans") / total, 1))


def select_model_inputs(features: DataFrame) -> DataFrame:
    return features.select(*S.FEATURES, F.col(S.TARGET).cast("int").alias(S.TARGET))
