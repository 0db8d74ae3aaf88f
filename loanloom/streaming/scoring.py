"""Scoring of arriving applications: stateless, the same expressions as the batch scorer."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.operators import scoring


def stream_score(record: Mapping, requests: DataFrame) -> DataFrame:
    """Requests with violations, and score, PD, decision, reasons and range warnings for the accepted ones."""
    checked = scoring.validate_application(requests)
    rows = scoring.score_batch(record, scoring.derive_model_input(checked))
    ok = F.col("accepted")
    rows = rows.withColumn("reasons", F.when(ok, scoring.reasons_column(record)))
    rows = rows.withColumn("outside", F.when(ok, scoring.outside_training_range(record)))
    return (rows.withColumn("decision", F.when(ok, scoring.policy_decision(F.col("pd"))))
            .withColumn("score", F.when(ok, F.col("score"))).withColumn("pd", F.when(ok, F.col("pd"))))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available into Parquet files, then stop.  The checkpoint makes a restart exactly-once."""
    (stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
