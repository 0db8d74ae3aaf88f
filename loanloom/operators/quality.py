"""Data checks as tables: (check, value, passed).  A gate raises when any check failed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom import settings as S


class DataCheckError(Exception):
    """A blocking check failed."""


def _rows(values: DataFrame, rules: Mapping[str, tuple[Column, Column]], by: Sequence[str] = ()) -> DataFrame:
    """Turn one aggregate row (per group) into check rows; each rule gives (value, passed)."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"),
                                        F.coalesce(ok, F.lit(False)).alias("passed")) for name, (value, ok) in rules.items()]))
    return values.select(*by, each.alias("c")).select(*by, "c.*")


def outside(c: str, low: float, high: float) -> Column:
    return F.col(c).isNull() | (F.col(c) < low) | (F.col(c) > high)


def orphan_rows(left: DataFrame, right: DataFrame, key: str = "loan_seq") -> DataFrame:
    """Rows of ``left`` whose key is absent from ``right``."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def dq_staging_checks(orig: DataFrame, label: DataFrame, max_missing: float = 0.01, max_rate: float = 0.20,
                      by: Sequence[str] = ()) -> DataFrame:
    """The fifteen staging checks: one aggregate per table and one anti join."""
    c = F.col
    none = lambda n: (c(n), c(n) == 0)
    o = orig.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("loan_seq").alias("keys"),
        F.count_if(c("vintage_year").isNull() | c("vintage_quarter").isNull()).alias("pattern"),
        F.count_if(c("orig_upb").isNull() | (c("orig_upb") <= 0)).alias("upb"),
        F.count_if(outside("int_rate", 0, 20)).alias("rate"), F.count_if(outside("orig_term", 60, 600)).alias("term"),
        F.count_if((c("dti") < 0) | (c("dti") > 65)).alias("dti"),
        F.count_if((c("credit_score") < 300) | (c("credit_score") > 850)).alias("score"),
        F.avg(c("credit_score").isNull().cast("int")).alias("missing"))
    checks = _rows(o, {
        "orig_not_empty": (c("n"), c("n") > 0), "orig_key_unique": (c("n") - c("keys"), c("n") == c("keys")),
        "key_pattern": none("pattern"), "orig_upb_positive": none("upb"), "int_rate_range": none("rate"),
        "orig_term_range": none("term"), "dti_range": none("dti"), "credit_score_range": none("score"),
        "score_missing_share": (c("missing"), c("missing") <= max_missing)}, by)
    label_rows = label
    g = label_rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("loan_seq").alias("keys"),
        F.count_if(c("observable_24m") & c("default_24m").isNull()).alias("unlabelled"),
        F.count_if(~c("default_24m").isin(0, 1)).alias("domain"),
        F.avg(F.when(c("observable_24m"), c("default_24m"))).alias("rate"))
    checks = checks.unionByName(_rows(g, {
        "label_key_unique": (c("n") - c("keys"), c("n") == c("keys")), "label_complete": none("unlabelled"),
        "label_domain": none("domain"),
        "default_rate_sane": (c("rate"), c("rate").isNull() | c("rate").between(0, max_rate))}, by))
    lost = label_rows.join(orig.select("loan_seq").distinct(), "loan_seq", "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("orphans"))
    if by:  # a group without orphans still reports zero
        lost = label_rows.select(*by).distinct().join(lost, list(by), "left").fillna(0, ["orphans"])
    checks = checks.unionByName(_rows(lost, {"no_orphans": none("orphans")}, by))
    leaking = [x for x in orig.columns if "default" in x or "delinq" in x or x.startswith("zero_balance")]
    names = orig.groupBy(*by).agg(F.lit(len(leaking)).alias("leak"))
    return checks.unionByName(_rows(names, {"no_label_like_columns": none("leak")}, by))


def column_set_check(df: DataFrame, expected: Sequence[str]) -> list[str]:
    """Columns on one side only."""
    return sorted(set(df.columns) ^ set(expected))


def dq_feature_checks(features: DataFrame, dev_max: int, oot_prefix: str = "test_oot") -> DataFrame:
    c = F.col
    oot = c("split").startswith(oot_prefix)
    a = features.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("loan_seq").alias("keys"),
        F.count_if(c("default_24m").isNull() | c("split").isNull()).alias("gaps"),
        F.count_if(oot & (c("vintage_year") <= dev_max)).alias("dev_in_oot"),
        F.count_if(~oot & (c("vintage_year") > dev_max)).alias("oot_in_dev"))
    odd = len(column_set_check(features, [*S.META, *S.FEATURES, *S.LABELS, "split"]))
    banned = len([f for f in S.FEATURES if f == "int_rate" or any(w in f for w in S.LEAK_WORDS)])
    zero = lambda n: (c(n), c(n) == 0)
    return _rows(a, {"expected_columns": (F.lit(odd), F.lit(odd == 0)), "label_and_split_present": zero("gaps"),
                     "key_unique": (c("n") - c("keys"), c("n") == c("keys")), "no_development_in_oot": zero("dev_in_oot"),
                     "no_oot_in_development": zero("oot_in_dev"), "no_banned_names": (F.lit(banned), F.lit(banned == 0))})


def dq_fresh_checks(fresh: DataFrame) -> DataFrame:
    c = F.col
    odd = len(column_set_check(fresh, [*S.META, *S.FEATURES, *S.FRESH_EXTRA, *S.LABELS, "split"]))
    a = fresh.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("loan_seq").alias("keys"),
                  F.count_if(c("default_24m").isNull()).alias("gaps"))
    return _rows(a, {"expected_columns": (F.lit(odd), F.lit(odd == 0)), "label_present": (c("gaps"), c("gaps") == 0),
                     "key_unique": (c("n") - c("keys"), c("n") == c("keys"))})


def dq_raw_checks(files: DataFrame, years: Sequence[int], kinds: Sequence[str] = ("orig", "perf")) -> DataFrame:
    """Expected (year, kind) pairs that are missing or empty; ``files`` has one (year, kind) row per record."""
    wanted = files.sparkSession.createDataFrame([(y, k) for y in years for k in kinds], "year int, kind string")
    found = files.groupBy("year", "kind").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(found.filter("n > 0"), ["year", "kind"], "left_anti")


# ---- declarative column rules -------------------------------------------------------------------
def dq_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _rows(one, {f"not_null:{c}": (F.col(c), F.col(c) == 0) for c in columns})


def dq_in_range(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Present values outside their range; NULL passes."""
    one = df.agg(*[F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in ranges.items()])
    return _rows(one, {f"in_range:{c}": (F.col(c), F.col(c) == 0) for c in ranges})


def dq_accepted_values(df: DataFrame, allowed: Mapping[str, Sequence]) -> DataFrame:
    one = df.agg(*[F.count_if(~F.col(c).isin(*values)).alias(c) for c, values in allowed.items()])
    return _rows(one, {f"accepted_values:{c}": (F.col(c), F.col(c) == 0) for c in allowed})


def dq_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of values that occur more than once, per column."""
    def repeated(c):
        again = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return _rows(again.agg(F.count(F.lit(1)).alias("dup")), {f"unique:{c}": (F.col("dup"), F.col("dup") == 0)})

    return reduce(lambda a, b: a.unionByName(b), [repeated(c) for c in columns])


def dq_relationships(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    lost = orphan_rows(child.filter(F.col(key).isNotNull()), parent, key).agg(F.count(F.lit(1)).alias("n"))
    return _rows(lost, {f"relationships:{key}": (F.col("n"), F.col("n") == 0)})


def dq_blocking_gate(checks: DataFrame) -> DataFrame:
    """Raise when a check failed (one collect of the failed names), else hand the checks on."""
    failed = [r["check"] for r in checks.filter(~F.col("passed")).select("check").collect()]
    if failed:
        raise DataCheckError("failed checks: " + ", ".join(sorted(failed)))
    return checks
