"""Writers, table registration and file manifests."""

from __future__ import annotations

import hashlib
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.sources.readers import _open_path

#: Bytes of a chunk that one task hashes, digests joined into one, bytes read at a time.
CHUNK, FAN, BLOCK = 64 << 20, 1024, 1 << 20


def sink_parquet_year(df: DataFrame, path: str, year: str = "source_year") -> None:
    """Compressed Parquet, one folder per year.

    Rows are rebalanced by year: small years share a writer, and a year beyond the advisory partition size is cut into
    several of about that size, as its volume asks for.
    """
    df.hint("rebalance", F.col(year)).write.mode("overwrite").partitionBy(year).option("compression", "zstd").parquet(path)


def sink_text(df: DataFrame, path: str, sep: str = "|") -> None:
    """Headerless delimited text, NULL as an empty field."""
    df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value")) \
        .write.mode("overwrite").text(path)


def sink_zip(lines: DataFrame, folder: str) -> DataFrame:
    """Write (archive, kind, line) rows as zip archives with one text member per kind; returns (archive, lines).

    One task streams one archive after the other from rows sorted by archive and kind; nothing is held whole.
    """
    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = member = archive = target = None
        counts: dict[str, int] = {}
        for batch in batches:
            for (name, kind), part in batch.groupby(["archive", "kind"], sort=False):
                if name != current:
                    if archive is not None:
                        member.close()
                        archive.close()
                        target.close()
                    filesystem, inner = _open_path(f"{folder}/{name}.zip")
                    filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    target = filesystem.open_output_stream(inner)
                    archive = zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED)
                    current, member, open_kind = name, None, None
                if member is None or kind != open_kind:
                    if member is not None:
                        member.close()
                    member, open_kind = archive.open(f"{name}_{kind}.txt", "w"), kind
                member.write(("\n".join(part["line"]) + "\n").encode())
                counts[name] = counts.get(name, 0) + len(part)
        if archive is not None:
            member.close()
            archive.close()
            target.close()
        if counts:
            yield pd.DataFrame({"archive": list(counts), "lines": list(counts.values())})

    ordered = lines.repartition("archive").sortWithinPartitions("archive", "kind")
    return ordered.mapInPandas(stream, "archive string, lines bigint")


def sink_table_overwrite(df: DataFrame, name: str, path: str | None = None) -> None:
    """Replace a table, schema included; with ``path`` the data lives there."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def schema_enforced_append(df: DataFrame, name: str) -> None:
    """Append only when names and types match the table."""
    want = {f.name: f.dataType for f in df.sparkSession.table(name).schema}
    got = {f.name: f.dataType for f in df.schema}
    if want != got:
        wrong = sorted({*want.items(), *got.items()} - ({*want.items()} & {*got.items()}), key=str)
        raise ValueError(f"schema mismatch with {name}: {[(c, t.simpleString()) for c, t in wrong]}")
    df.select(*want).write.insertInto(name)


def report_sink(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report (an aggregate of a few rows) as one file."""
    getattr(df.coalesce(1).write.mode("overwrite"), kind)(path)


def external_table_ddl(df: DataFrame, name: str, location: str) -> str:
    """CREATE EXTERNAL TABLE text from the DataFrame's schema."""
    unsupported = [f.name for f in df.schema if re.match(r"interval|void|variant", f.dataType.simpleString())]
    if unsupported:
        raise ValueError(f"no table type known for {unsupported}")
    body = ",\n  ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return (f"CREATE EXTERNAL TABLE IF NOT EXISTS {name} (\n  {body}\n)\nSTORED AS PARQUET\nLOCATION '{location}'\n"
            f"TBLPROPERTIES ('parquet.compression'='ZSTD')")


def register_external_table(spark: SparkSession, df: DataFrame, name: str, location: str) -> DataFrame:
    return spark.catalog.createTable(name, path=location, source="parquet", schema=df.schema)


def register_lake_views(spark: SparkSession, tables: dict[str, str]) -> list[str]:
    """One temporary view per lake table over its Parquet files."""
    for name, pattern in tables.items():
        spark.read.parquet(pattern).createOrReplaceTempView(name)
    return sorted(tables)


def listed_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, size) of the files that match, or lie in folders that match; hidden ones are left out, empty ones are not."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(pattern)
    filesystem = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = []
    for status in filesystem.globStatus(folder) or []:
        inside = filesystem.listFiles(status.getPath(), True)
        while inside.hasNext():
            file = inside.next()
            if not file.getPath().getName().startswith(("_", ".")):
                found.append((file.getPath().toString(), file.getLen()))
    return spark.createDataFrame(found, "path string, size bigint")


def file_manifest(spark: SparkSession, pattern: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(name, size, sha256) of every file, from byte ranges that are hashed apart.

    A file of up to ``chunk`` bytes has its plain SHA-256.  A larger one has the root of a hash tree: the SHA-256 of its
    chunks, then of the joined hexadecimal digests of up to ``fan`` neighbours, level by level.  So a file of any size is
    many short tasks, and compares with another manifest of the same chunk and fan.
    """
    listed = listed_files(spark, pattern)
    longest = listed.agg(F.max("size")).first()[0] or 0
    last = F.greatest(F.ceil(F.col("size") / chunk) - 1, F.lit(0))
    ranges = listed.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part")).repartition("path", "part")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                filesystem, inner = _open_path(row.path)
                digest, at, end = hashlib.sha256(), row.part * chunk, min((row.part + 1) * chunk, row.size)
                with filesystem.open_input_file(inner) as file:
                    file.seek(at)
                    while at < end:
                        block = file.read(min(BLOCK, end - at))
                        if not block:
                            raise OSError(f"{row.path} ends at {at}, not at {row.size}")
                        digest.update(block)
                        at += len(block)
                found.append(digest.hexdigest())
            yield batch.assign(sha256=found)

    tree = ranges.mapInPandas(digests, "path string, size bigint, part bigint, sha256 string")
    nodes, span = max(1, -(-longest // chunk)), chunk
    while nodes > 1:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "sha256"))), lambda s: s["sha256"]), "")
        grown = tree.groupBy("path", "size", F.floor(F.col("part") / fan).alias("parent")).agg(joined.alias("joined"))
        at_root = F.col("size") <= span  # its only node stays as it is
        tree = grown.select("path", "size", F.col("parent").alias("part"), F.when(at_root, F.col("joined")).otherwise(F.sha2("joined", 256)).alias("sha256"))
        nodes, span = -(-nodes // fan), span * fan
    return tree.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size", "sha256")


def file_manifest_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """What to upload, skip, or question: one row per file name on either side."""
    mine = local.select("name", F.col("size").alias("local_size"), F.col("sha256").alias("local_sha"))
    theirs = remote.select("name", F.col("size").alias("remote_size"), F.col("sha256").alias("remote_sha"),
                           F.lit(True).alias("there"))
    both = mine.join(theirs, "name", "full_outer")
    action = (F.when(F.col("local_sha").isNull(), "unexpected")
              .when(F.col("remote_sha") == F.col("local_sha"), "skip").otherwise("upload"))
    problem = (F.when(F.col("local_sha").isNull(), F.lit(None).cast("string"))
               .when(F.col("there").isNull(), "missing")
               .when(F.col("remote_size") != F.col("local_size"), "size differs")
               .when(~F.col("remote_sha").eqNullSafe(F.col("local_sha")), "checksum differs"))
    return both.select("name", action.alias("action"), problem.alias("problem"), "local_size", "remote_size")
