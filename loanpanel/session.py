"""Spark session set-up shared by the library, the tests and the bench.

The settings that matter at scale are AQE (runtime coalescing of shuffle
partitions, skew-join splitting), a UTC session clock (dates compared
against the SQL oracle), and a shared checkpoint folder for cutting long
lineages.  The checkpoint folder is always read from the session
(``spark.checkpoint.dir``); a local default is only set when the cluster
did not name one, which is the case in tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "loanpanel",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's defaults.

    Without a cluster (no ``master`` and no ``SPARK_MASTER``) the session is
    ``local[$BENCH_CPUS or *]`` with one shuffle partition per core.  On a
    cluster the launcher's master and sizing win; only AQE, the UTC clock and
    the UI switch are set, and AQE coalesces the shuffle partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    local = master is None and not os.environ.get("SPARK_MASTER")
    if local:
        master = f"local[{os.environ.get('BENCH_CPUS', '*')}]"
    if master:
        builder = builder.master(master)
    if local or (master or "").startswith("local"):
        cores = master[len("local["):-1] if master.startswith("local[") else "1"
        cores = str(os.cpu_count() or 8) if cores in ("*", "") else cores
        parts = shuffle_partitions or int(os.environ.get("LOANPANEL_SHUFFLE_PARTITIONS", cores))
        builder = (builder.config("spark.sql.shuffle.partitions", str(parts))
                          .config("spark.driver.memory", os.environ.get("LOANPANEL_DRIVER_MEMORY", "16g")))
    elif shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # exact percentiles keep one value-count map per group; hash up to 4,096
        # groups per task before sorting (a loan's map is at most its months, so
        # this stays tens of MB per task), instead of the default 128
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; a local one is set only if it is unset and the master is local."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="loanpanel-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
