"""Skew check: one loan holding a third of all panel rows.

Re-keys every third order to one existing loan (no rows dropped), runs the
feature table with Spark's event log written to a scratch folder, and reads
per-task shuffle records from the log.  For contrast it also runs the
direct plan (one window over the whole loan).  Usage:

    python tools/skew_check.py [sf_dir] [chunk_rows]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from loanpanel.operators import panel as P  # noqa: E402
from loanpanel.plans import driver_tables as T  # noqa: E402


def stage_task_records(log_dir: str) -> dict:
    """stage id -> list of shuffle records read per task, from the event log."""
    per_stage = defaultdict(list)
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerTaskEnd":
                    continue
                m = ev.get("Task Metrics") or {}
                read = (m.get("Shuffle Read Metrics") or {})
                recs = read.get("Total Records Read", 0)
                if recs:
                    per_stage[(ev["Stage ID"], ev["Stage Attempt ID"])].append(recs)
    return per_stage


def run(label, build, spark_conf, sf_dir, extra=None):
    log_dir = tempfile.mkdtemp(prefix="run-skew-")
    builder = SparkSession.builder
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = (builder.master("local[8]").appName(label)
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.autoBroadcastJoinThreshold", "-1")   # force the cluster-scale joins
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")  # show the task spread
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.ui.enabled", "false")
             .config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false")
             .config("spark.checkpoint.dir", spark_conf)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()
    stages = stage_task_records(log_dir)
    print(f"== {label}")
    for (sid, _), recs in sorted(stages.items()):
        total = sum(recs)
        print(f"  stage {sid:3d}: tasks={len(recs):3d} records={total:8d} "
              f"max/task={max(recs):8d} ({100.0 * max(recs) / total:5.1f} %)")


def hot_panel(spark, sf_dir):
    p = T.panel(spark, sf_dir)
    return p.withColumn("loan", F.when(F.col("obs") % 3 == 0, F.lit(1)).otherwise(F.col("loan")))


def hot_period(spark, sf_dir):
    """A third of all rows in one (loan, period)."""
    p = T.panel(spark, sf_dir)
    hot = F.col("obs") % 3 == 0
    return p.withColumn("loan", F.when(hot, F.lit(1)).otherwise(F.col("loan"))).withColumn("d", F.when(hot, F.lit("1995-01-01").cast("date")).otherwise(F.col("d")))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    chunk = int(sys.argv[2]) if len(sys.argv) > 2 else 5000
    ckpt = tempfile.mkdtemp(prefix="run-skew-ckpt-")
    C = T.PANEL_COLS

    def chunked(spark, d):
        p = hot_panel(spark, d)
        return P.loan_feature_table(p, p.select("loan").distinct(), C, chunk_rows=chunk)

    def direct(spark, d):
        p = hot_panel(spark, d)
        w = Window.partitionBy("loan").orderBy("d", "obs")
        r = p.withColumn("rate3", (F.max("upb").over(w.rowsBetween(-2, 0))
                                   - F.min("upb").over(w.rowsBetween(-2, 0))) / 3)
        return r.groupBy("loan").agg(F.max("rate3"))

    def row_flags(spark, d):
        return P.loan_wide(hot_panel(spark, d), C)

    def period_rows(spark, d):
        return P.ranked_rows(hot_period(spark, d), C, segments=64)

    def period_marks(spark, d):
        return P.prior_default_rows(hot_period(spark, d), C, chunk_rows=chunk)

    run("hot (loan, period): positions by segments", period_rows, ckpt, sf_dir)
    run(f"hot (loan, period): prior-default rows (chunk_rows={chunk})", period_marks, ckpt, sf_dir)
    run(f"chunked feature table (chunk_rows={chunk})", chunked, ckpt, sf_dir)
    run("direct window over the whole loan", direct, ckpt, sf_dir)
    def loan_months(spark, d):
        # the test file is one parquet row group (one map task); AQE splits a
        # skewed partition along map outputs, so spread the rows over 16 map
        # tasks as a multi-file table would be
        return hot_panel(spark, d).repartition(16).join(T.loans(spark, d), "loan", "inner")

    run("loan-wide flags through the (loan, period) join", row_flags, ckpt, sf_dir)
    # rows joined to their loan: both sides are plain shuffles, so AQE's
    # skew-join split applies (thresholds lowered to this small data)
    run("panel joined to loans, AQE skew-join split", loan_months, ckpt, sf_dir, {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"})

if __name__ == "__main__":
    main()
