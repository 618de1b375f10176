"""Session construction for tests, bench and the command line."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "postmill", cores: str | int | None = None, shuffle_partitions: int = 8,
                  **extra: str) -> SparkSession:
    """A local session in UTC with adaptive execution.  On a cluster the master comes from spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("POSTMILL_DRIVER_MEMORY", "8g"))
    )
    if cores is not None or "MASTER" not in os.environ:
        builder = builder.master(f"local[{cores or '*'}]")
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder of spark.checkpoint.dir; a temporary one on a local master."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(rows: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder that :func:`scratch` also uses."""
    sc = rows.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch(rows.sparkSession, "checkpoints"))
    return rows.checkpoint()


#: Rows that cross to a Python worker at once, and their bytes: a batch ends where either is reached.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session from here on, so what a worker holds does not grow with the rows of a task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly if a scan has fewer splits than the cluster has cores; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
