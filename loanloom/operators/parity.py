"""Comparing tables: set and multiset differences, tolerant comparison, fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _sided(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("*", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select("*", F.lit(0).alias("_a"), F.lit(1).alias("_b")))


def symmetric_difference(a: DataFrame, b: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """Distinct rows present on one side only.

    One grouped pass over the union: equal rows meet map-side and the table is shuffled once, not twice per direction.
    """
    g = _sided(a, b).groupBy(*a.columns).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return g.filter(F.col("_a") != F.col("_b")).select(F.when(F.col("_a") == 1, left).otherwise(right).alias("side"), *a.columns)


def plain_text(df: DataFrame, name: str, places: int = 6) -> Column:
    """A column as text, floating point as a decimal of so many places, so that engines can be compared by value."""
    real = dict(df.dtypes)[name] in ("double", "float")
    return (F.round(name, places).cast(f"decimal(38,{places})") if real else F.col(name)).cast("string")


def normalise(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[plain_text(df, c, places).alias(c) for c in df.columns])


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many more copies of a row one side has, after normalising."""
    g = _sided(normalise(a), normalise(b)).groupBy(*a.columns).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    gap = F.col("_a") - F.col("_b")
    return g.filter(gap != 0).select(F.when(gap > 0, "left").otherwise("right").alias("side"), F.abs(gap).alias("copies"), *a.columns)


def _same(x: Column, y: Column, kind: str, rel: float, tol: float) -> Column:
    if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal"):
        a, b = x.cast("double"), y.cast("double")
        close = F.abs(a - b) <= F.greatest(F.lit(tol), rel * F.greatest(F.abs(a), F.abs(b)))
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        close = F.substring(x.cast("string"), 1, 10) == F.substring(y.cast("string"), 1, 10)
    else:
        close = x.cast("string") == y.cast("string")
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(close)


def table_parity(a: DataFrame, b: DataFrame, keys: Sequence[str], rel: float = 1e-9, tol: float = 1e-6) -> DataFrame:
    """Typed, tolerant, NULL-aware comparison by key: one row per difference."""
    kinds = dict(a.dtypes)
    values = [c for c in a.columns if c not in keys]
    left = a.select(*keys, F.struct(*values).alias("_l"))
    right = b.select(*keys, F.struct(*values).alias("_r"))
    both = left.join(right, list(keys), "full_outer")
    whole = F.when(F.col("_r").isNull(), F.struct(F.lit("*").alias("column"), F.lit("present").alias("left"), F.lit(None).cast("string").alias("right"))) \
        .when(F.col("_l").isNull(), F.struct(F.lit("*").alias("column"), F.lit(None).cast("string").alias("left"), F.lit("present").alias("right")))
    each = [F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull() & ~_same(F.col(f"_l.{c}"), F.col(f"_r.{c}"), kinds[c], rel, tol),
                   F.struct(F.lit(c).alias("column"), F.col(f"_l.{c}").cast("string").alias("left"), F.col(f"_r.{c}").cast("string").alias("right")))
            for c in values]
    found = F.array_compact(F.array(whole, *each))
    return both.select(*keys, F.explode(found).alias("d")).select(*keys, "d.*")


def parity_full_compare(a: DataFrame, b: DataFrame, order: Sequence[str]) -> DataFrame:
    """Compare two ordered reports row by row; reports are aggregates of a few rows."""
    place = F.row_number().over(Window.orderBy(*order)).alias("row")
    return table_parity(a.select(place, "*"), b.select(place, "*"), ["row"])


PRINT = ("n_rows", "hash_a", "hash_b")


def row_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """One text per row that no other row has: each value with its length before it, NULL as N, nested values as JSON.

    Values keep all their digits, so any change of any column shows.
    """
    def text(name: str) -> Column:
        kind = df.schema[name].dataType.typeName()
        if kind in ("array", "map", "struct"):
            return F.to_json(F.struct(F.col(name)), {"ignoreNullFields": "false"})
        return F.hex(name) if kind == "binary" else F.col(name).cast("string")

    return F.concat(*[F.coalesce(F.concat(F.char_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("N")) for c in columns])


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Order-free content hash of all columns (or those named): row count and sums of two 32-bit slices of each row's MD5.

    The sums are whole numbers, so prints of disjoint parts add up to the print of the whole (``combine_prints``).
    Columns count in the order of their names.
    """
    digest = F.md5(row_text(df, sorted(columns or [c for c in df.columns if c not in by])).cast("binary"))
    half = lambda start: F.sum(F.conv(F.substring(digest, start, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), half(1).alias("hash_a"), half(9).alias("hash_b"))


def combine_prints(added: DataFrame, removed: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Prints of parts added up, and of parts taken away again, without a look at their rows; empty sums vanish."""
    def signed(df, sign):
        return df.select(*by, *[(F.col(c).cast("decimal(38,0)") * sign).cast("decimal(38,0)").alias(c) for c in PRINT])

    both = signed(added, 1) if removed is None else signed(added, 1).unionByName(signed(removed, -1))
    sums = both.groupBy(*by).agg(F.sum("n_rows").cast("bigint").alias("n_rows"), *[F.sum(c).cast("string").alias(c) for c in PRINT[1:]])
    return sums.filter("n_rows <> 0 or hash_a <> '0' or hash_b <> '0'")


def file_prints(spark: SparkSession, pattern: str, known: DataFrame | None = None) -> DataFrame:
    """(file, size, modified, n_rows, hash_a, hash_b) of every Parquet file now there.

    Files that stand in ``known`` with the same size and time keep their print unread; only the others are scanned.
    """
    listed = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    same = listed.join(known, ["file", "size", "modified"]) if known is not None else None
    todo = listed if known is None else listed.join(known, ["file", "size", "modified"], "left_anti")
    paths = [r["file"] for r in todo.select("file").collect()]  # file names, as Spark's own listing holds them
    if not paths:
        return same if same is not None else todo.select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(PRINT, ("bigint", "string", "string"))])
    rows = spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("_file"))
    prints = table_fingerprint(rows, by=["_file"]).withColumnRenamed("_file", "file")
    fresh = todo.join(prints, "file", "left").select("file", "size", "modified", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                                                     *[F.coalesce(c, F.lit("0")).alias(c) for c in PRINT[1:]])
    return fresh if same is None else same.select(fresh.columns).unionByName(fresh)


def manifest_compare(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Which fingerprinted parts changed, appeared or vanished."""
    s = stored.select(key, F.struct(*PRINT).alias("_s"))
    c = current.select(key, F.struct(*PRINT).alias("_c"))
    state = (F.when(F.col("_s").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.col("_s") != F.col("_c"), "changed")
             .otherwise("same"))
    return s.join(c, key, "full_outer").select(key, state.alias("state"))


def golden_answers(answers: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """The answers of control queries (a few rows each) as text rows: query, row, column, value."""
    def part(name, df, order):
        place = F.row_number().over(Window.orderBy(*order)) if order else F.lit(1)
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.lit(c).alias("name"), plain_text(df, c).alias("value"))
                                    for i, c in enumerate(df.columns)]))
        return df.withColumn("row", place).select(F.lit(name).alias("query"), "row", cells.alias("c")).select("query", "row", "c.*")

    return reduce(lambda a, b: a.unionByName(b), [part(n, df, order) for n, (df, order) in answers.items()])
