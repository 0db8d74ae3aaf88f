"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanloom import settings as S


def clip(c: Column, low: float, high: float) -> Column:
    """Clip to [low, high]; NULL stays NULL."""
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def logit(p: Column, eps: float = 1e-12) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def expit(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit_shift(p: Column, delta: Column | float, eps: float = 1e-12) -> Column:
    """Add a constant on the log-odds scale."""
    return expit(logit(p, eps) + delta)


def safe_ratio(top: Column, bottom: Column) -> Column:
    return top / F.nullif(bottom.cast("double"), F.lit(0.0))


def level_error(mean_predicted: Column, mean_observed: Column) -> Column:
    return F.abs(F.log(safe_ratio(mean_predicted, mean_observed)))


def psi_term(ref_share: Column, cur_share: Column, floor: float = S.MONITORING["share_floor"]) -> Column:
    ref = F.greatest(ref_share, F.lit(floor))
    cur = F.greatest(cur_share, F.lit(floor))
    return (cur - ref) * F.log(cur / ref)


def psi_flag(value: Column, warn: float = S.MONITORING["psi_warn"], alert: float = S.MONITORING["psi_alert"]) -> Column:
    return F.when(value >= alert, "alert").when(value >= warn, "warn").otherwise("ok")


def level_flag(ratio: Column) -> Column:
    low_alert, high_alert = S.MONITORING["level_alert"]
    low_warn, high_warn = S.MONITORING["level_warn"]
    unusable = ratio.isNull() | F.isnan(ratio) | (F.abs(ratio) == float("inf"))
    return (F.when(unusable | (ratio < low_alert) | (ratio > high_alert), "alert")
            .when((ratio < low_warn) | (ratio > high_warn), "warn").otherwise("ok"))


def wilson_interval(successes: Column, n: Column, z: float = 1.96) -> Column:
    """Struct(low, high) of the Wilson score interval; (0, 0) for an empty group."""
    total = F.nullif(n.cast("double"), F.lit(0.0))
    share = successes / total
    scale = 1 + z * z / total
    centre = (share + z * z / (2 * total)) / scale
    half = z * F.sqrt(share * (1 - share) / total + z * z / (4 * total * total)) / scale
    return F.struct(F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0)).alias("low"),
                    F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(0.0)).alias("high"))


def theory_cutoff(margin: Column, loss: Column) -> Column:
    return margin / (margin + loss)
