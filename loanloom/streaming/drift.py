"""Stability index per day of arrivals against a fixed profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom import settings as S
from loanloom.operators.monitoring import drift_flags, drift_universe, psi


def score_band(column: str, width: float = S.MONITORING["score_band_points"]):
    return F.floor(F.col(column) / width)


def profile(df: DataFrame, column: str) -> DataFrame:
    """Reference counts per band."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.lit("score").alias("monitor"), score_band(column).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, column: str, ts: str = "ts", window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(window start, band) -> n.  State holds one counter per open window and band; the watermark drops late rows."""
    timed = stream.filter(F.col(column).isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return (timed.groupBy(F.window("_ts", window), score_band(column).alias("band")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("window_start"), F.lit("score").alias("monitor"), "band", "n"))


def stream_drift_window(counts: DataFrame, reference: DataFrame, path: str, checkpoint: str) -> None:
    """Write index and flag of every closed window.

    Each micro-batch holds whole closed windows (append mode).  It is written under its own batch number, so a
    replayed batch replaces its earlier output.
    """
    def emit(batch: DataFrame, number: int) -> None:
        values = drift_flags(psi(drift_universe(reference, batch, "window_start"), ["window_start", "monitor"]))
        sizes = batch.groupBy("window_start").agg(F.sum("n").alias("arrivals"))
        values.join(sizes, "window_start").write.mode("overwrite").parquet(f"{path}/batch={number}")

    (counts.writeStream.outputMode("append").foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True)
     .start().awaitTermination())
