"""Session settings the operators are written for.

On a cluster the session comes from the platform; ``configure`` only sets
what is missing.  ``local_session`` is for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every plan here relies on: AQE re-plans joins from measured sizes
# (broadcast only a side it has measured, split skewed partitions) and
# coalesces small shuffle partitions.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in RECOMMENDED.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
    return spark


def bounded_batches(spark: SparkSession | None = None) -> None:
    """Hand texts to Python workers 8 MB at a time, unless the session says otherwise.

    Both the executor and the worker hold a batch; Spark's own bound is 64 MB.
    """
    spark = spark or SparkSession.getActiveSession()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and spark.conf.get(name, None) is None:
        spark.conf.set(name, str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, which all executors share."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return d


def checkpoint_dir(spark: SparkSession) -> str:
    """``shared_dir``; where it is unset, in local mode (tests), a scratch folder."""
    if spark.sparkContext.master.split("[")[0] == "local" and not (
        spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    ):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusterms-ckpt-"))
    d = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corpusterms") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CORPUSTERMS_DRIVER_MEMORY", "8g"))
    )
    for k, v in RECOMMENDED.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
