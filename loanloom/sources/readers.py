"""Readers: delimited text, zip members, Parquet by column name, guarded splits."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from loanloom import settings as S

LINES_PER_BATCH = 20_000


def text_schema(columns: Sequence[str]) -> ST.StructType:
    return ST.StructType([ST.StructField(c, ST.StringType()) for c in columns])


def scan_delimited_text(spark: SparkSession, path: str | list[str], columns: Sequence[str], sep: str = "|") -> DataFrame:
    """Headerless, unquoted text with given names; every column stays text and a malformed line stops the job."""
    return (spark.read.schema(text_schema(columns)).option("sep", sep).option("header", False).option("quote", "")
            .option("mode", "FAILFAST").csv(path))


def scan_space_delimited(spark: SparkSession, path: str, columns: Sequence[str] = S.CONSUMER_COLUMNS) -> DataFrame:
    return scan_delimited_text(spark, path, columns, sep=" ")


def _open_path(path: str):
    if "://" in path or path.startswith("file:"):
        filesystem, inner = pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and
                                                     not path.startswith("file://") else path)
    else:
        filesystem, inner = pafs.LocalFileSystem(), path
    return filesystem, inner


def scan_zip_members(spark: SparkSession, pattern: str, members: dict[str, str]) -> DataFrame:
    """(archive, kind, line) of the expected members of every archive; ``members`` maps kind -> member name.

    ``{stem}`` in a member name stands for the archive's file name without its ending.  Each (archive, member) pair is
    one task that streams the member in bounded batches, so neither archive nor member is ever held whole.  Only the
    named members are opened; an archive without one of them is an error.
    """
    archives = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("archive"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(m).alias("member")) for k, m in members.items()]))
    stem = F.regexp_extract("archive", r"([^/]+)\.zip$", 1)
    # a given number of ranges, as tasks so small would otherwise be merged into one
    tasks = max(1, archives.count() * len(members))
    work = (archives.select("archive", wanted.alias("w"))
            .select("archive", "w.kind", F.replace("w.member", F.lit("{stem}"), stem).alias("member"))
            .repartitionByRange(tasks, "archive", "member"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                filesystem, inner = _open_path(row.archive)
                with filesystem.open_input_file(inner) as raw, zipfile.ZipFile(raw) as archive:
                    if row.member not in archive.namelist():
                        raise ValueError(f"{row.archive} does not contain {row.member}")
                    with io.TextIOWrapper(archive.open(row.member), encoding="utf-8") as text:
                        held: list[str] = []
                        for line in text:
                            held.append(line.rstrip("\r\n"))
                            if len(held) >= LINES_PER_BATCH:
                                yield pd.DataFrame({"archive": row.archive, "kind": row.kind, "line": held})
                                held = []
                        if held:
                            yield pd.DataFrame({"archive": row.archive, "kind": row.kind, "line": held})

    return work.mapInPandas(stream, "archive string, kind string, line string")


def lines_to_columns(lines: DataFrame, columns: Sequence[str], sep: str = "|") -> DataFrame:
    """Split lines into text columns; a wrong field count stops the job, an empty field becomes NULL."""
    parts = F.split("line", "\\" + sep, -1)
    checked = F.when(F.size(parts) == len(columns), parts).otherwise(
        F.raise_error(F.concat(F.lit("wrong number of fields: "), F.size(parts).cast("string"))).cast("array<string>"))
    extra = [c for c in lines.columns if c != "line"]
    return (lines.withColumn("_f", checked)
            .select(*extra, *[F.nullif(F.col("_f")[i], F.lit("")).alias(c) for i, c in enumerate(columns)]))


def scan_parquet_by_name(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Many Parquet files whose columns are matched by name; a column a file lacks is NULL there."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.option("mergeSchema", True).parquet(*paths)


def tag_source_year(parts: dict[int, DataFrame]) -> DataFrame:
    """Union by name of yearly tables, each row tagged with the year of its file."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [df.withColumn("source_year", F.lit(year)) for year, df in parts.items()])


def _guard(requested: Iterable[str], known: Iterable[str], open_splits: Iterable[str], allowed: bool) -> list[str]:
    names = [requested] if isinstance(requested, str) else list(requested)
    unknown = sorted(set(names) - set(known))
    if unknown:
        raise ValueError(f"unknown split(s): {unknown}")
    locked = sorted(set(names) - set(open_splits))
    if locked and not allowed:
        raise PermissionError(f"{locked} are locked test splits")
    return names


def load_split_guarded(features: DataFrame, splits: str | Iterable[str], allow_test: bool = False,
                       test_splits: Sequence[str] = ("test_in_time", "test_oot_1", "test_oot_2")) -> DataFrame:
    """Rows of the named splits; test splits need permission.  The filter reaches the scan (pruning when partitioned)."""
    names = _guard(splits, (*S.DEVELOPMENT_SPLITS, *test_splits), S.DEVELOPMENT_SPLITS, allow_test)
    return features.filter(F.col("split").isin(*names))


def load_fresh_guarded(fresh: DataFrame, vintages: Iterable[int] | None = None, allow_exam: bool = False) -> DataFrame:
    if not allow_exam:
        raise PermissionError("the holdout vintages are locked")
    return fresh if vintages is None else fresh.filter(F.col("split").isin(*[f"fresh_{int(v)}" for v in vintages]))
