"""Profit, cut-offs, expected loss and measured loss severity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions.stats import safe_ratio, theory_cutoff
from loanloom.operators.metrics import quantile_edges
from loanloom.operators.ranks import equal_size_bins, running_before
from loanloom.operators.selection import group_quantiles
from loanloom.session import write_scratch


def loan_profit(y: Column, ead: Column, margin: Column | float, loss: Column | float) -> Column:
    return F.when(y == 0, margin * ead).otherwise(-(loss * ead))


def realised_profit(df: DataFrame, approve: Column, margin: float, loss: float, by: Sequence[str] = ()) -> DataFrame:
    gain = F.when(approve, loan_profit(F.col("y"), F.col("ead"), F.lit(margin), F.lit(loss))).otherwise(0.0)
    return df.groupBy(*by).agg(F.sum(gain).alias("profit"))


def money_cells(df: DataFrame) -> DataFrame:
    """Distinct PD -> loans, defaults and exposure of goods and bads."""
    good = F.col("y") == 0
    return df.groupBy(F.col("pd").cast("double").alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(good, F.col("ead")).otherwise(0.0)).alias("ead_good"),
        F.sum(F.when(good, 0.0).otherwise(F.col("ead"))).alias("ead_bad"))


def threshold_totals(df: DataFrame, points: int = S.MONEY["curve_points"]) -> DataFrame:
    """Per candidate threshold (quantiles of the PD from the median up, deduplicated): loans and exposure approved.

    Every PD is put into the bucket of the first threshold that approves it; the running totals then go over at most
    ``points`` rows, whatever the size of the table.
    """
    cells = money_cells(df)
    shares = [0.5 + 0.5 * i / (points - 1) for i in range(points)]
    edges = quantile_edges(running_before(cells, ["n"]), shares).select(F.array_sort(F.array_distinct("edges")).alias("t"))
    placed = cells.withColumn("_t", edges.scalar()).withColumn(
        "threshold", F.get("_t", F.size(F.filter("_t", lambda t: t < F.col("x")))))
    sums = ("n", "ead_good", "ead_bad")
    buckets = placed.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in sums])
    # an interpolated threshold may hold no PD of its own, it still is a row of the curve
    every = edges.select(F.explode("t").alias("threshold")).join(buckets, "threshold", "left").fillna(0, list(sums))
    upto = Window.orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    return every.select("threshold", *[F.sum(c).over(upto).alias(c) for c in sums],
                        *[F.sum(c).over(whole).alias(f"total_{c}") for c in sums])


def profit_curve(df: DataFrame, margin: float, loss: float, points: int = S.MONEY["curve_points"]) -> DataFrame:
    return threshold_totals(df, points).select(
        "threshold", safe_ratio(F.col("n"), F.col("total_n")).alias("approval_rate"),
        (margin * F.col("ead_good") - loss * F.col("ead_bad")).alias("profit"))


def best_row(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The most profitable threshold; the lowest one wins a tie."""
    best = F.max_by(F.struct("threshold", "approval_rate", "profit"), F.struct(F.col("profit"), -F.col("threshold")))
    return curve.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def best_cutoff(df: DataFrame, margin: float, loss: float, points: int = S.MONEY["curve_points"]) -> DataFrame:
    return best_row(profit_curve(df, margin, loss, points))


def sensitivity_grid(df: DataFrame, margins: Sequence[float], losses: Sequence[float]) -> DataFrame:
    """Best line and gain over approving everyone for every (margin, loss), from one set of threshold totals."""
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.lit(k).alias("loss")) for m in margins for k in losses]))
    m, k = F.col("g.margin"), F.col("g.loss")
    curve = threshold_totals(df).withColumn("g", grid).select(
        m.alias("margin"), k.alias("loss"), "threshold", safe_ratio(F.col("n"), F.col("total_n")).alias("approval_rate"),
        (m * F.col("ead_good") - k * F.col("ead_bad")).alias("profit"),
        (m * F.col("total_ead_good") - k * F.col("total_ead_bad")).alias("base"),
        (F.col("total_ead_good") + F.col("total_ead_bad")).alias("exposure"))
    best = F.max_by(F.struct("threshold", "approval_rate", "profit", "base", "exposure"),
                    F.struct(F.col("profit"), -F.col("threshold")))
    gain = F.col("b.profit") - F.col("b.base")
    return curve.groupBy("margin", "loss").agg(best.alias("b")).select(
        "margin", "loss", theory_cutoff(F.col("margin"), F.col("loss")).alias("theory_cutoff"),
        F.col("b.threshold").alias("best_cutoff"), F.col("b.approval_rate").alias("approval_rate"),
        gain.alias("profit_gain_vs_approve_all"), safe_ratio(gain, F.col("b.exposure")).alias("gain_pct_of_exposure"))


def decision_report(df: DataFrame, threshold: float, margin: float, loss: float, by: Sequence[str] = ()) -> DataFrame:
    """What a line does to every group, next to approving and refusing everyone: one aggregate."""
    approve, y = F.col("pd") <= threshold, F.col("y")
    profit = loan_profit(y, F.col("ead"), F.lit(margin), F.lit(loss))
    bads, goods = F.sum(y), F.count_if(y == 0)
    return df.groupBy(*by).agg(
        F.avg(approve.cast("double")).alias("approval_rate"), F.avg(y).alias("default_rate_all"),
        F.avg(F.when(approve, y)).alias("default_rate_approved"),
        safe_ratio(F.sum(F.when(approve, 0).otherwise(y)), bads).alias("defaults_refused_share"),
        (F.count_if(~approve & (y == 0)) / F.greatest(goods, F.lit(1))).alias("good_loans_refused_share"),
        F.sum(F.when(approve, profit).otherwise(0.0)).alias("profit_with_line"),
        F.sum(profit).alias("profit_approve_all"), F.lit(0.0).alias("profit_refuse_all"),
        F.sum("ead").alias("total_exposure"))


def loss_scenarios(df: DataFrame, threshold: float, margin: float, losses: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Profit with the line and for approving everyone under every loss level, as shares of exposure."""
    approve, good = F.col("pd") <= threshold, F.col("y") == 0
    ead = F.col("ead")
    sums = df.groupBy(*by).agg(
        F.sum(F.when(good & approve, ead).otherwise(0.0)).alias("in_good"), F.sum(F.when(~good & approve, ead).otherwise(0.0)).alias("in_bad"),
        F.sum(F.when(good, ead).otherwise(0.0)).alias("all_good"), F.sum(F.when(~good, ead).otherwise(0.0)).alias("all_bad"))
    each = sums.withColumn("loss", F.explode(F.array(*[F.lit(float(k)) for k in losses])))
    exposure = F.col("all_good") + F.col("all_bad")
    with_line = safe_ratio(margin * F.col("in_good") - F.col("loss") * F.col("in_bad"), exposure)
    everyone = safe_ratio(margin * F.col("all_good") - F.col("loss") * F.col("all_bad"), exposure)
    return each.select(*by, "loss", with_line.alias("with_line_pct"), everyone.alias("approve_all_pct"),
                       (with_line - everyone).alias("gain_pct"))


def el_by_band(df: DataFrame, loss: float, key: str, n_bands: int = 10) -> DataFrame:
    """Predicted against observed expected loss over equal-count PD bands."""
    banded = equal_size_bins(df.select(key, "pd", "y", "ead"), "pd", key, n_bands, out="band")
    sums = banded.groupBy((F.col("band") + 1).alias("band")).agg(
        F.count(F.lit(1)).alias("loans"), F.avg("pd").alias("mean_pd"), F.avg("y").alias("default_rate"),
        F.sum("ead").alias("exposure"), F.sum(F.col("pd") * loss * F.col("ead")).alias("predicted_el"),
        F.sum(F.col("y") * loss * F.col("ead")).alias("observed_el"))
    return sums.withColumn("el_ratio", safe_ratio(F.col("predicted_el"), F.col("observed_el")))


# ---- measured losses ----------------------------------------------------------------------------
def loss_events(perf: DataFrame) -> DataFrame:
    """Months that ended a loan with a credit event."""
    return perf.filter(F.col("zero_balance_code").isin(*S.CREDIT_EVENT_CODES)).select(
        "loan_seq", F.col("actual_loss").try_cast("double").alias("actual_loss"),
        F.col("zero_balance_removal_upb").try_cast("double").alias("upb_at_end"))


def join_loss_events(loans: DataFrame, perf: DataFrame) -> DataFrame:
    """Left join; a loan with two credit-event months appears twice (``duplicate_events`` counts such loans)."""
    ends = loss_events(perf).withColumn("loss_event", F.lit(True))
    return loans.join(ends, "loan_seq", "left").withColumn("loss_event", F.coalesce("loss_event", F.lit(False)))


def duplicate_events(perf: DataFrame) -> DataFrame:
    per_loan = loss_events(perf).groupBy("loan_seq").agg(F.count(F.lit(1)).alias("events"))
    return per_loan.agg(F.count(F.lit(1)).alias("loans_with_event"), F.count_if(F.col("events") > 1).alias("loans_with_several"),
                        F.sum("events").alias("event_rows"))


def lgd_summary(loans: DataFrame, perf: DataFrame, by: str = "vintage_year") -> DataFrame:
    """Loss severity per vintage: ratio of sums, median ratio, share without loss, loss per flagged loan."""
    flagged = F.col("default_24m") == 1
    amount = F.col("loss_event") & F.col("actual_loss").isNotNull()
    loss, upb = F.col("actual_loss"), F.col("upb_at_end")

    def over(cond, value):
        return F.sum(F.when(cond, value))

    rows = write_scratch(join_loss_events(loans, perf).select(by, "default_24m", "orig_upb", "loss_event", "actual_loss", "upb_at_end"), "losses")
    sums = rows.groupBy(by).agg(
        F.count_if(flagged).alias("flagged_defaults"), F.count_if(flagged & F.col("loss_event")).alias("flagged_with_loss_event"),
        F.count_if("loss_event").alias("loss_event_loans"), F.count_if(amount).alias("loss_event_with_amount"),
        F.round(safe_ratio(over(amount, loss), over(amount, upb)), 4).alias("lgd_loss_events"),
        F.round(F.avg(F.when(amount, (loss <= 0).cast("int"))), 4).alias("share_no_loss_or_gain"),
        F.round(safe_ratio(over(flagged, F.coalesce(loss, F.lit(0.0))), over(flagged, F.col("orig_upb"))), 4).alias("loss_per_flag"))
    middle = group_quantiles(rows.filter(amount).select(by, safe_ratio(loss, upb).alias("share")), "share", [by], [0.5])
    middle = middle.select(F.col(by).alias("_of"), F.round(F.col("quantiles")[0], 4).alias("median_loss_share"))
    return sums.join(middle, F.col(by).eqNullSafe(F.col("_of")), "left").drop("_of")


def lifetime_loss(perf: DataFrame) -> DataFrame:
    """Actual loss of every loan over its whole life; NULL months count as zero, gains stay negative."""
    amount = F.coalesce(F.col("actual_loss").try_cast("double"), F.lit(0.0))
    return perf.groupBy("loan_seq").agg(F.sum(amount).alias("lifetime_loss"))


def join_loss_lookup(df: DataFrame, losses: DataFrame) -> DataFrame:
    return df.join(losses, "loan_seq", "left").withColumn("lifetime_loss", F.coalesce("lifetime_loss", F.lit(0.0)))


def realised_loss_share(df: DataFrame, losses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return join_loss_lookup(df, losses).groupBy(*by).agg(
        F.sum("lifetime_loss").alias("loss"), F.sum("ead").alias("exposure"),
        safe_ratio(F.sum("lifetime_loss"), F.sum("ead")).alias("loss_pct_of_exposure"))
