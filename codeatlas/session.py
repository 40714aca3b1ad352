"""Session construction and the few cluster settings the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job assumes: UTC, ANSI semantics, adaptive execution with skew-join splitting.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Checkpoint files of datasets no longer referenced are removed by the context cleaner.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "codeatlas", extra: dict | None = None) -> SparkSession:
    """Builder used by tests, bench and the examples. On a cluster pass master=None and let
    spark-submit decide; every setting here can be overridden by the caller."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = "12g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Reliable checkpoints go to the shared folder the cluster names in ``spark.checkpoint.dir``.
    Only when nothing is configured (local tests) do we create a scratch folder ourselves."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="codeatlas-ckpt-", dir=os.environ.get("CODEATLAS_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def target_partitions(spark: SparkSession) -> int:
    """Partition count for explicit range repartitions: the shuffle setting, never below the cores."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(n, spark.sparkContext.defaultParallelism)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.  The planner guesses the size of derived texts from the few
    bytes they are made of, and would send whole tables through the driver."""
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores, by a hash of the whole row, before work in Python that takes far longer
    than reading: small or well compressed input comes in few partitions, whatever it holds."""
    n = max(32, 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, F.xxhash64(*df.columns))
