"""Streaming twins of the batch scorer and the drift monitor on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.operators import scoring
from loanloom.plans import loans
from loanloom.plans.oracle import register
from loanloom.plans.preparation import _path, rounded
from loanloom.plans.registry import query
from loanloom.plans.summaries import _VIOLATIONS, requests
from loanloom.streaming.drift import profile, stream_drift_window, windowed_counts
from loanloom.streaming.scoring import run_to_end, stream_score

register("checked", f"SELECT loan_seq, ({_VIOLATIONS})='' AS accepted FROM requests")


@query("stream_score", """SELECT loan_seq, accepted, CASE WHEN accepted THEN round(score,6) END AS score, CASE WHEN accepted THEN round(pd,6) END AS pd,
    CASE WHEN accepted THEN CASE WHEN pd<0.02::double THEN 'approve' WHEN pd>0.05::double THEN 'decline' ELSE 'refer' END END AS decision
    FROM fact_scored JOIN checked USING (loan_seq)""")
def _(spark, sf):
    source, out = _path(spark, "requests"), _path(spark, "answers")
    rows = requests(spark, sf)
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    answers = stream_score(scoring.adopted_model(), stream).select("loan_seq", "accepted", "score", "pd", "decision")
    run_to_end(answers, out, _path(spark, "answers-log"))
    return rounded(spark.read.parquet(out), "score", "pd")


register("closed", """SELECT date_trunc('day', ts) AS window_start, CAST(floor(value/20.0::double) AS bigint) AS band, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1,2
    HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
register("event_profile", "SELECT CAST(floor(value/20.0::double) AS bigint) AS band, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")


@query("stream_drift_window", """
    SELECT CAST(window_start AS varchar) AS window_start, CAST(sum(c) AS bigint) AS arrivals, round(sum((cs-rs)*ln(cs/rs)),6) AS psi,
      CASE WHEN sum((cs-rs)*ln(cs/rs))>=0.25::double THEN 'alert' WHEN sum((cs-rs)*ln(cs/rs))>=0.1::double THEN 'warn' ELSE 'ok' END AS flag FROM (
      SELECT w.window_start, coalesce(k.n,0) AS c, greatest(coalesce(k.n,0)/(sum(coalesce(k.n,0)) OVER (PARTITION BY w.window_start))::double,0.0001::double) AS cs,
        greatest(p.n/(sum(p.n) OVER (PARTITION BY w.window_start))::double,0.0001::double) AS rs
      FROM (SELECT DISTINCT window_start FROM closed) w CROSS JOIN event_profile p LEFT JOIN closed k ON k.window_start=w.window_start AND k.band=p.band) GROUP BY 1""")
def _(spark, sf):
    out = _path(spark, "drift")
    events = loans.table(spark, sf, "events").select("ts", "value")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream_drift_window(windowed_counts(stream, "value"), profile(events, "value"), out, _path(spark, "drift-log"))
    df = spark.read.parquet(out).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "arrivals", "psi", "flag")
    return rounded(df, "psi")
