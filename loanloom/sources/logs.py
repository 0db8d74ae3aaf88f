"""Service log lines -> latency summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: field name in the log -> column
FIELDS = {"Duration": "duration_ms", "Billed Duration": "billed_ms", "Memory Size": "memory_size_mb",
          "Max Memory Used": "max_memory_used_mb", "Init Duration": "init_ms"}


def parse_report_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fields of REPORT lines; other lines and reports without a duration are dropped.  Cold starts carry an init time."""
    def field(name):
        return F.nullif(F.regexp_extract(column, rf"(?:^|[^A-Za-z ])\s*{name}: ([0-9.]+) (?:ms|MB)", 1), F.lit("")).try_cast("double")

    parsed = lines.filter(F.col(column).startswith("REPORT")).select(*[field(n).alias(c) for n, c in FIELDS.items()])
    return parsed.filter(F.col("duration_ms").isNotNull()).withColumn("cold_start", F.col("init_ms").isNotNull())


def latency_summary(reports: DataFrame) -> DataFrame:
    """n, min, median, nearest-rank p95 and max per measure, and the billed GB-seconds of the window."""
    warm = F.when(~F.col("cold_start"), F.col("duration_ms"))
    cold = F.when(F.col("cold_start"), F.col("duration_ms"))
    measures = {"init_ms": F.col("init_ms"), "duration_ms_warm": warm, "duration_ms_cold": cold, "billed_ms": F.col("billed_ms"),
                "max_memory_used_mb": F.col("max_memory_used_mb")}
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("x")) for m, v in measures.items()]))
    # nearest rank and middle value are read off the distinct values, so a measure is never sorted in one task buffer of rows
    cells = reports.select(long.alias("m")).select("m.*").filter("x IS NOT NULL").groupBy("measure", "x").agg(F.count(F.lit(1)).alias("n"))
    from loanloom.operators.ranks import running_before

    ranked = running_before(cells, ["n"], ["measure"])
    after = F.col("before_n") + F.col("n")
    total = F.col("total_n")
    holds = lambda rank: (F.col("before_n") < rank) & (rank <= after)
    low, high = F.floor((total + 1) / 2), F.ceil((total + 1) / 2)
    stats = ranked.groupBy("measure").agg(
        F.sum("n").alias("n"), F.min("x").alias("min"),
        F.round((F.max(F.when(holds(low), F.col("x"))) + F.max(F.when(holds(high), F.col("x")))) / 2, 4).alias("median"),
        F.max(F.when(holds(F.ceil(0.95 * total)), F.col("x"))).alias("p95"), F.max("x").alias("max"))
    billed = reports.agg(F.round(F.sum("billed_ms") / 1000 * F.coalesce(F.max("memory_size_mb"), F.lit(0.0)) / 1024, 4))
    return stats.withColumn("billed_gb_seconds", billed.scalar())
