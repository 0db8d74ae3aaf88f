"""Ranking and calibration metrics computed exactly from (score -> n, bad) cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions.stats import level_error, safe_ratio
from loanloom.operators.ranks import equal_size_bins, running_before, score_cells
from loanloom.operators.selection import group_quantiles


def rank_measures():
    """Aggregates over cells carrying before_/total_ sums of n and bad, in ascending order of x."""
    n, bad, x = F.col("n"), F.col("bad"), F.col("x")
    good = n - bad
    before_bad, before_good = F.col("before_bad"), F.col("before_n") - F.col("before_bad")
    all_n, all_bad = F.col("total_n"), F.col("total_bad")
    all_good = all_n - all_bad
    pairs = safe_ratio(F.sum(bad * (before_good + 0.5 * good)), F.max(all_bad).cast("double") * F.max(all_good))
    gap = safe_ratio(before_good, all_good) - safe_ratio(before_bad, all_bad)
    precision = (all_bad - before_bad) / (all_n - F.col("before_n"))
    return {
        "n": F.sum(n), "defaults": F.sum(bad),
        "default_rate": F.sum(bad) / F.sum(n), "mean_predicted_pd": F.sum(n * x) / F.sum(n),
        "auc": pairs, "gini": 2 * pairs - 1, "ks": F.greatest(F.max(gap), F.lit(0.0)),
        "pr_auc": F.sum(safe_ratio(bad, all_bad) * precision),
        "brier": F.sum(bad * (1 - x) * (1 - x) + good * x * x) / F.sum(n),
    }


#: Measures that are sums over cells and need no order.
ADDITIVE = {"n", "defaults", "default_rate", "mean_predicted_pd", "brier"}


def evaluate_cells(cells: DataFrame, by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    ordered = names is None or not ADDITIVE.issuperset(names)
    ranked = running_before(cells, ["n", "bad"], by) if ordered else cells
    measures = [m.alias(k) for k, m in rank_measures().items() if names is None or k in names]
    return ranked.groupBy(*by).agg(*measures)


def evaluate(df: DataFrame, y: str, p: str, by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """n, defaults, rates, AUC, Gini, KS, average precision and Brier per group in one pass."""
    return evaluate_cells(score_cells(df, p, y, by), by, names)


def evaluate_by_vintage(df: DataFrame, y: str, p: str, by: Sequence[str] = ("vintage_year",),
                        min_defaults: int = S.MIN_DEFAULTS_VINTAGE) -> DataFrame:
    return evaluate(df, y, p, by).filter(F.col("defaults") >= min_defaults)


def cumulative_curve(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative bads and goods from the riskiest score down: the basis of ROC and precision-recall curves."""
    c = running_before(score_cells(df, p, y, by), ["n", "bad"], by)
    caught_bad = F.col("total_bad") - F.col("before_bad")
    caught = F.col("total_n") - F.col("before_n")
    caught_good = caught - caught_bad
    return c.select(*by, F.col("x").alias("threshold"), caught_bad.alias("cum_bad"), caught_good.alias("cum_good"),
                    safe_ratio(caught_bad, F.col("total_bad")).alias("tpr"),
                    safe_ratio(caught_good, F.col("total_n") - F.col("total_bad")).alias("fpr"))


def calibration_table(df: DataFrame, y: str, p: str, key: str, n_bins: int = 10) -> DataFrame:
    return equal_size_bins(df.select(key, y, p), p, key, n_bins).groupBy("bin").agg(
        F.count(F.lit(1)).alias("loans"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"))


def ece(df: DataFrame, y: str, p: str, key: str, n_bins: int = 10) -> DataFrame:
    """Count-weighted mean gap between predicted and observed over equal-count bins."""
    gap = F.abs(F.col("predicted") - F.col("observed"))
    return calibration_table(df, y, p, key, n_bins).agg(
        (F.sum(F.col("loans") * gap) / F.sum("loans")).alias("ece"))


def reliability_curve_quantile(df: DataFrame, y: str, p: str, n_bins: int = 8) -> DataFrame:
    """Observed against predicted over quantile bins of p itself; rows with the same p share a bin.

    The quantile edges are read off the running counts of distinct p, with linear interpolation between ranks.
    """
    cells = running_before(score_cells(df, p, y), ["n"])
    inner = quantile_edges(cells, [i / n_bins for i in range(1, n_bins)])
    binned = cells.withColumn("_edges", inner.scalar()).withColumn(
        "bin", F.size(F.filter("_edges", lambda e: e < F.col("x"))))
    return binned.groupBy("bin").agg(F.sum("n").alias("loans"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("predicted"),
                                     (F.sum("bad") / F.sum("n")).alias("observed"))


def quantile_edges(cells: DataFrame, shares: Sequence[float]) -> DataFrame:
    """One row holding the array of linearly interpolated quantiles, from cells with before_n / total_n."""
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)])

    def position(q):
        return q["share"] * (F.col("total_n") - 1)

    def here(rank):
        return (F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n"))

    touching = F.filter(wanted, lambda q: here(F.floor(position(q))) | here(F.ceil(position(q))))
    picked = cells.withColumn("q", F.explode(touching)).groupBy(F.col("q.i").alias("i")).agg(
        F.min("x").alias("a"), F.max("x").alias("b"), F.max(position(F.col("q")) - F.floor(position(F.col("q")))).alias("f"))
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("f")
    ordered = F.sort_array(F.collect_list(F.struct(F.col("i"), value.alias("v"))))
    return picked.agg(F.transform(ordered, lambda s: s["v"]).alias("edges"))


def reliability_by_vintage(df: DataFrame, y: str, versions: Sequence[str], vintage: str = "vintage_year",
                           min_defaults: int = S.MIN_DEFAULTS_VINTAGE) -> DataFrame:
    """Mean PD, observed rate and Brier per vintage and probability version (one column per version)."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("defaults"), F.avg(y).alias("observed")]
    sums += [F.avg(v).alias(f"mean_{v}") for v in versions]
    sums += [F.avg(F.pow(F.col(v) - F.col(y), 2)).alias(f"brier_{v}") for v in versions]
    wide = df.groupBy(vintage).agg(*sums).filter(F.col("defaults") >= min_defaults)
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"mean_{v}").alias("mean_predicted_pd"),
                                        F.col(f"brier_{v}").alias("brier")) for v in versions]))
    return wide.select(vintage, "n", "defaults", "observed", each.alias("e")).select(vintage, "n", "defaults", "observed", "e.*")


def level_table(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Observed and predicted level, ratio, level error and default-count miss per group."""
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("loans"), F.sum(F.col(y).cast("bigint")).alias("defaults"),
                               F.sum(p).alias("predicted_defaults"), F.avg(y).alias("observed_rate"),
                               F.avg(p).alias("predicted_rate"))
    return (sums.withColumn("ratio", safe_ratio(F.col("observed_rate"), F.col("predicted_rate")))
            .withColumn("level_error", level_error(F.col("predicted_rate"), F.col("observed_rate")))
            .withColumn("default_count_miss", F.abs(F.col("predicted_defaults") - F.col("defaults"))))


def confusion_matrix(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """Counts, accuracy and per-class precision, recall and F1 from one aggregate."""
    hit = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    c = df.agg(*[F.count_if((F.col(y) == a) & (F.col(predicted) == b)).alias(k) for k, (a, b) in hit.items()])
    tn, fp, fn, tp = (F.col(k) for k in hit)

    def f1(p, r):
        return safe_ratio(2 * p * r, p + r)

    bad_p, bad_r = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    good_p, good_r = safe_ratio(tn, tn + fn), safe_ratio(tn, tn + fp)
    return c.select("*", safe_ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
                    bad_p.alias("precision_bad"), bad_r.alias("recall_bad"), f1(bad_p, bad_r).alias("f1_bad"),
                    good_p.alias("precision_good"), good_r.alias("recall_good"), f1(good_p, good_r).alias("f1_good"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks for ties.

    Both columns are reduced to joint cells (a, b -> n); average ranks come from the running counts of each column's
    distinct values and are joined back to the cells, so no row-level rank is needed.
    """
    joint = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(
        F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).agg(F.count(F.lit(1)).alias("n"))

    def average_rank(side):
        cells = joint.groupBy(F.col(side).alias("x")).agg(F.sum("n").alias("n"))
        return running_before(cells, ["n"]).select(F.col("x").alias(side), (F.col("before_n") + (F.col("n") + 1) / 2).alias(f"rank_{side}"))

    ranked = joint.join(average_rank("a"), "a").join(average_rank("b"), "b")
    # centred on the known mean rank (N + 1) / 2, which keeps the sums well conditioned
    n = F.col("n")
    half = joint.agg(((F.sum("n") + 1) / 2)).scalar()
    da, db = F.col("rank_a") - half, F.col("rank_b") - half
    return ranked.agg((F.sum(n * da * db) / F.sqrt(F.sum(n * da * da) * F.sum(n * db * db))).alias("spearman"))


def pooled_and_by_vintage(df: DataFrame, y: str, p: str, vintage: str = "vintage_year",
                          min_defaults: int = S.MIN_DEFAULTS_VINTAGE) -> DataFrame:
    """Additive measures of every vintage and of the pool in one GROUPING SETS pass."""
    out = df.groupingSets([[F.col(vintage)], []], F.col(vintage)).agg(
        F.grouping(vintage).cast("int").alias("pooled"), F.count(F.lit(1)).alias("loans"),
        F.sum(F.col(y).cast("bigint")).alias("defaults"), F.avg(y).alias("observed"), F.avg(p).alias("predicted"))
    return out.filter((F.col("pooled") == 1) | (F.col("defaults") >= min_defaults))


def percentile_ci(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """2.5 and 97.5 percentiles of replicate values; NaN and NULL dropped."""
    both = group_quantiles(df, value, by, [0.025, 0.975])
    return both.select(*by, F.col("quantiles")[0].alias("low"), F.col("quantiles")[1].alias("high"))


def running_share(df: DataFrame, part: str) -> DataFrame:
    """Share of the total, for tables of a few aggregated rows."""
    return df.withColumn("share", safe_ratio(F.col(part), F.sum(part).over(Window.partitionBy())))
