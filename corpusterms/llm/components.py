"""Connected components of a large graph, by alternating star steps."""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, scratch, stored


def _stars(edges: DataFrame) -> bool:
    """No node points at two others, nor at one and is pointed at."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg((F.sum("out") + F.max("into")).alias("ends"))
    return (ends.agg(F.max("ends")).first()[0] or 0) <= 1


def components(edges: DataFrame, path: str | None = None) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)``; root: its least node.

    Large-star and small-star steps: every node is pointed at the least node
    it can see until each points at its root.  Edges never outnumber the
    input's; what a step leaves is written to the shared folder (no lineage to
    replay after a loss), what it makes on the way is kept until then (AQE can
    split the partition of a very large star).
    """
    path = path or scratch(edges.sparkSession)
    start = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now = stored(start, f"{path}/0")
    step = 0
    while not _stars(now):
        step += 1
        with ExitStack() as until:
            both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            least = kept(least, until)
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = kept(large, until)
            low = kept(large.groupBy("u").agg(F.min("v").alias("m")), until)
            small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = stored(small.union(low).distinct(), f"{path}/{step}")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
