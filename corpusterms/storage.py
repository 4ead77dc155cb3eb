"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import uuid
from contextlib import ExitStack

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import checkpoint_dir


def scratch(spark: SparkSession) -> str:
    """A new folder name under the shared checkpoint folder of the session."""
    return os.path.join(checkpoint_dir(spark), f"table-{uuid.uuid4().hex}")


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage (a lost executor recomputes nothing above it), and the
    joins that follow have plain scans as inputs, so that AQE may split a
    skewed partition (it can't behind an aggregate).
    """
    path = path or scratch(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, until: ExitStack) -> DataFrame:
    """``df`` on the executors' disks, until ``until`` closes.

    For small tables between two stored ones, which a lost executor may have
    computed again: no files are written (for each, Hadoop's local file system
    starts some three processes).  The columns lie in one struct, so a join
    doesn't know how the rows are dealt and shuffles them, as it would a stored
    table's: AQE may split a skewed partition.
    """
    rows = df.select(F.struct(*df.columns).alias("row")).persist(StorageLevel.DISK_ONLY)
    until.callback(rows.unpersist)
    return rows.select("row.*")
