"""Column functions that turn raw text into typed, sentinel-free values."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanloom import settings as S


def text_or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def int_or_null(c: Column, unavailable: str | None = None) -> Column:
    """Whole number, or NULL for blank text, the unavailable code and anything unparseable."""
    cleaned = text_or_null(c)
    if unavailable is not None:
        cleaned = F.nullif(cleaned, F.lit(unavailable))
    return cleaned.try_cast("int")


def double_or_null(c: Column) -> Column:
    return text_or_null(c).try_cast("double")


def allow_list(c: Column, allowed: Iterable[str]) -> Column:
    return F.when(c.isin(*allowed), c)


def month_start(c: Column) -> Column:
    """First day of a six-digit ``YYYYMM`` month; anything else is NULL."""
    iso = F.concat(F.substring(c, 1, 4), F.lit("-"), F.substring(c, 5, 2), F.lit("-01"))
    return F.when(F.length(c) == 6, iso.try_cast("date"))


def range_or_null(c: Column, low: float, high: float) -> Column:
    return F.when(c.between(low, high), c)


def vintage_year(loan_key: Column) -> Column:
    two_digits = F.substring(loan_key, 2, 2).try_cast("int")
    return two_digits + F.when(two_digits >= S.CENTURY_PIVOT, 1900).otherwise(2000)


def vintage_quarter(loan_key: Column) -> Column:
    return F.substring(loan_key, 5, 1).try_cast("int")


def months_after_vintage(first_payment: Column, year: Column, quarter: Column) -> Column:
    """Months from the first month of the vintage quarter to the first payment month."""
    return F.year(first_payment) * 12 + F.month(first_payment) - (year * 12 + quarter * 3 - 2)


def several_borrowers(n_borrowers: Column) -> Column:
    return F.when(n_borrowers.isNotNull(), (n_borrowers >= 2).cast("double"))


def term_class(orig_term: Column) -> Column:
    """True for long terms; NULL terms form their own class."""
    return orig_term > S.SHORT_TERM_MONTHS


def target_map(risk: Column) -> Column:
    """1 (good) -> 0, 2 (bad) -> 1, anything else -> NULL."""
    return F.when(risk == 1, 0).when(risk == 2, 1)


def fill_missing_level(c: Column, level: str = "missing") -> Column:
    return F.coalesce(c.cast("string"), F.lit(level))


def nearest_reference(year: Column, references: Sequence[int]) -> Column:
    """The reference year closest to ``year``; the earlier entry of ``references`` wins a tie."""
    candidates = [F.struct(F.abs(year - r).alias("gap"), F.lit(i).alias("pos"), F.lit(r).alias("ref"))
                  for i, r in enumerate(references)]
    return (F.least(*candidates) if len(candidates) > 1 else candidates[0])["ref"]
