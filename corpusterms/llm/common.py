"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_batches  # noqa: F401
from ..storage import kept, scratch, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker (workers are reused)."""
    name = "_corpusterms_llm_worker_cache"
    module = sys.modules.get(name)
    if module is None:
        module = sys.modules.setdefault(name, types.ModuleType(name))
        module.entries = {}
    return module.entries


def parts(spark: SparkSession, per_task: int, total: int) -> int:
    """Shuffle partitions so that each holds about ``per_task`` of ``total``."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, -(-int(total) // per_task))


def least_rows(docs: DataFrame, grouped) -> DataFrame:
    """One row of ``docs`` for each group: that of the least ``doc_id``.

    ``grouped`` takes ``(doc_id, text)`` and gives ``(doc_id, group)``, the
    least ``doc_id`` of the row's group.  Where a ``doc_id`` is null or
    repeated, rows are numbered, and the row of a group is chosen by
    ``doc_id`` (null last), a hash of the text, and the number.
    """
    ids = docs.groupBy("doc_id").count().agg(F.max("count"), F.max(F.col("doc_id").isNull())).first()
    if (ids[0] or 0) <= 1 and not ids[1]:
        keep = grouped(docs).where("doc_id = group").select("doc_id")
        return docs.join(keep, "doc_id", "left_semi")
    path = scratch(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = stored(docs.select(F.monotonically_increasing_id().alias("number"), row.alias("row")), f"{path}/rows")
    found = grouped(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")))
    found = stored(found.select(F.col("doc_id").alias("number"), "group"), f"{path}/found")
    rank = F.struct(
        F.col("row.doc_id").isNull(), F.col("row.doc_id").cast("long"), F.xxhash64("row.text"), F.col("number").alias("number")
    )
    ranked = rows.select("number", rank.alias("rank")).join(found, "number")
    keep = ranked.groupBy("group").agg(F.min("rank").alias("rank")).select("rank.number")
    return rows.join(stored(keep, f"{path}/least"), "number", "left_semi").select("row.*")


def share(*cols) -> Column:
    """A number from 0 to 1 that a row's columns decide, as good as random."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))
