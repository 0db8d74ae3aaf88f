"""Time the headline queries: one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from loanloom.plans import QUERIES, loans
from loanloom.session import local_session

# raw -> staged -> features first (nothing reused), then the control queries and one query per analytics family
HEADLINE = (
    "feature_table", "stage_origination", "label_per_loan", "dq_staging_checks",
    "control_dev_split_counts", "control_dev_vintage_sums", "control_fresh_structure", "control_raw_orig_loans",
    "control_raw_perf_rows", "control_raw_perf_loans",
    "split_summary", "exclusion_waterfall", "rate_spread", "score_batch", "explain_batch", "evaluate", "evaluate_by_vintage",
    "calibration_table", "profit_curve", "sensitivity_grid", "fairness_report", "drift_by_vintage", "lgd_summary", "symmetric_difference",
    "table_fingerprint", "woe_table", "within_vintage_iv", "signed_gini_by_vintage",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the JVM's task machinery before timing
    times = {}
    t = time.perf_counter()
    loans.features(spark, sf_dir).count()  # staged once; its cost is reported, later queries scan it
    times["stage_once"] = round(time.perf_counter() - t, 3)
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
