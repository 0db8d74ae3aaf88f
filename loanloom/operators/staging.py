"""Typed origination rows, monthly flags and the 24-month label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.functions import typing as T

_INTEGERS = {"mi_pct": "999", "n_units": "99", "cltv": "999", "dti": "999", "ltv": "999", "orig_term": None,
             "n_borrowers": "99"}
_AMOUNTS = ("orig_upb", "int_rate")
_MONTHS = ("first_payment_date", "maturity_date")
_FREE_TEXT = ("msa", "amort_type", "state", "zip3", "seller_name", "program_indicator")
_CODES = {"first_time_homebuyer": "YN", "occupancy": "PIS", "channel": "RBCT", "ppm_flag": "YN", "purpose": "PCNR",
          "super_conforming": "YN", "io_indicator": "YN", "property_type": ("SF", "PU", "CO", "MH", "CP")}

# fixed values: column order of the staged table
STAGED_ORDER = [
    "loan_seq", "vintage_year", "vintage_quarter", "credit_score", "first_payment_date", "maturity_date",
    "first_time_homebuyer", "msa", "mi_pct", "n_units", "occupancy", "cltv", "dti", "orig_upb", "ltv", "int_rate",
    "channel", "ppm_flag", "amort_type", "state", "property_type", "zip3", "purpose", "orig_term", "n_borrowers",
    "seller_name", "super_conforming", "program_indicator", "relief_refi", "io_indicator",
]


def _typed(name: str):
    """How one raw text column becomes a typed column."""
    raw = F.col(name)
    if name in _INTEGERS:
        return T.int_or_null(raw, _INTEGERS[name])
    if name in _AMOUNTS:
        return T.double_or_null(raw)
    if name in _MONTHS:
        return T.month_start(raw)
    if name in _CODES:
        return T.allow_list(raw, _CODES[name])
    if name in _FREE_TEXT:
        return T.text_or_null(raw)
    return {"vintage_year": T.vintage_year(F.col("loan_seq")),
            "vintage_quarter": T.vintage_quarter(F.col("loan_seq")),
            "credit_score": T.range_or_null(T.int_or_null(F.col("credit_score")), 300, 850),
            "relief_refi": F.coalesce(F.col("relief_refi") == "Y", F.lit(False)),
            }.get(name, raw)


def seasoning_flag(df: DataFrame) -> DataFrame:
    """Months between vintage start and first payment, and the flag for loans seasoned more than half a year."""
    gap = T.months_after_vintage(F.col("first_payment_date"), F.col("vintage_year"), F.col("vintage_quarter"))
    return (df.withColumn("months_after_vintage", gap)
            .withColumn("is_seasoned_or_modified", F.col("months_after_vintage") > S.SEASONED_AFTER_MONTHS))


def stage_origination(raw: DataFrame) -> DataFrame:
    """One narrow projection: nothing is filtered, exclusions are only flagged."""
    return seasoning_flag(raw.select(*[_typed(c).alias(c) for c in STAGED_ORDER]))


def performance_flags(perf: DataFrame) -> DataFrame:
    """NULL-safe monthly booleans."""
    def certain(cond):
        return F.coalesce(cond, F.lit(False))

    status = F.col("delinq_status")
    ended = F.col("zero_balance_code")
    return perf.select(
        "loan_seq",
        F.col("loan_age").try_cast("int").alias("age"),
        certain((status.try_cast("int") >= S.LATE_MONTHS) | (status == "RA")).alias("late90"),
        certain(ended.isin(*S.CREDIT_EVENT_CODES)).alias("credit_event"),
        ended.isNotNull().alias("ended"),
        F.col("borrower_assist_code").isNotNull().alias("assist"),
    )


def label_per_loan(perf: DataFrame) -> DataFrame:
    """24-month label, three definitions, from one aggregation by loan.

    All measures are max/or, so the partial aggregate shrinks each loan to one row per map task before the shuffle and
    no loan, however long its history, is ever held as a group.
    """
    within = F.col("age") <= S.WINDOW_MONTHS
    late, event = F.col("late90"), F.col("credit_event")
    definitions = {"default_24m": (late & ~F.col("assist")) | event,
                   "default_24m_all_late": late | event,
                   "default_24m_loss_only": event}
    per_loan = performance_flags(perf).groupBy("loan_seq").agg(
        F.max("age").alias("max_age"),
        F.coalesce(F.bool_or(F.col("ended") & within), F.lit(False)).alias("ended_in_window"),
        *[F.coalesce(F.bool_or(rule & within), F.lit(False)).alias(name) for name, rule in definitions.items()],
    )
    observable = (F.col("max_age") >= S.WINDOW_MONTHS) | F.col("ended_in_window")
    return per_loan.select("loan_seq", "max_age", observable.alias("observable_24m"),
                           *[F.when(observable, F.col(name).cast("int")).alias(name) for name in definitions])


def stage_report(orig: DataFrame, label: DataFrame, by: str = "vintage_year") -> DataFrame:
    """Loan, exclusion and default counts per vintage, with loans that have no label row kept."""
    one = F.lit(1)
    counts = {"relief_refi": F.col("relief_refi"), "seasoned_or_modified": F.col("is_seasoned_or_modified"),
              "not_observable_24m": ~F.col("observable_24m")}
    sums = {"defaults_b": "default_24m", "defaults_a_all_late": "default_24m_all_late",
            "defaults_c_loss_only": "default_24m_loss_only"}
    return orig.join(label, "loan_seq", "left").groupBy(by).agg(
        F.count(one).alias("loans"),
        *[F.count_if(cond).alias(name) for name, cond in counts.items()],
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name) for name, c in sums.items()])
