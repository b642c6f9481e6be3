"""Session and checkpoint helpers.

The library never creates a machine-local scratch folder on a cluster: the
checkpoint directory is taken from the session (``spark.checkpoint.dir``) and a
private one is created only when nothing is configured (local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    "spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024),
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", app: str = "assaygraph", **conf) -> SparkSession:
    """A local session for tests and the bench (cluster jobs use their own)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**_LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring it when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder; it is used as
    is (and its absence is an error).  Only in local mode with nothing
    configured (tests) a private folder below the system temp dir is created.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint dir
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (e.g. on HDFS or an "
                               "object store) for reliable checkpoints")
        configured = tempfile.mkdtemp(prefix="assaygraph-ckpt-")   # local mode only (tests)
    sc.setCheckpointDir(configured)
    return configured


def parallelism(spark: SparkSession) -> int:
    """Task slots of the cluster (shuffle partitions under Spark Connect)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001
        return shuffle_partitions(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss; never ``localCheckpoint``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint dir for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for intermediate tables")
    return os.path.join(base, "tables", name) if "://" not in base else f"{base.rstrip('/')}/tables/{name}"
