"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source; a row's fractional
rank, (rank - 1/2) / rows of its source, says how far down its source it lies.
Sorted by fractional rank all sources run out at the same pace, so every
contiguous cut matches the mixture; cutting the order into equal counts puts
at most one row more into one shard than into another (the law ``rows``).

No row number needs a source, or the whole table, in one task: both rankings
count rows by cells of the ordering key first, add up the counts before each
cell, and number rows within a cell.  Only keys and digests are shuffled, never
texts.

Defined results: a null text has size 1 and the digest of the empty string;
rows without a source are a source of their own; repeated rows are rows like
any other (they are ordered by all that is returned of them, so their order
doesn't matter); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored

#: Cells that an ordering key's range is cut into.
CELLS = 4096


def _numbered(rows: DataFrame, group: list[str], cell: Column, order: list, name: str) -> DataFrame:
    """``rows`` with ``name``: the row's number from 0 within ``group``.

    ``cell`` rises with ``order`` (rows of a smaller cell come first).
    """
    rows = rows.withColumn("_cell", cell)
    counts = rows.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_held"))
    # At most CELLS counts a group; without a group these few are all there is.
    w = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*group, "_cell", F.coalesce(F.sum("_held").over(w), F.lit(0)).alias("_before"))
    same = rows.join(before, [*group, "_cell"])
    inner = Window.partitionBy(*group, "_cell").orderBy(*order)
    return same.withColumn(name, F.col("_before") + F.row_number().over(inner) - 1).drop("_cell", "_before")


def interleaved_shards(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """``(doc_id, source, size, text_crc32, law, shard, slot, grown_shard)``."""
    path = scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")).alias("shuffled"),
    )
    rows = stored(rows, f"{path}/rows")
    cell = F.shiftright("shuffled", 64 - CELLS.bit_length() + 1)
    ranked = _numbered(rows, ["source"], cell, ["shuffled", "doc_id", "size", "text_crc32"], "rank")
    totals = rows.groupBy("source").agg(F.count(F.lit(1)).alias("of"))
    ranked = ranked.join(totals, "source").withColumn("depth", (F.col("rank") + 0.5) / F.col("of"))
    ranked = stored(ranked.drop("rank", "of"), f"{path}/ranked")
    cell = F.floor(F.col("depth") * CELLS)
    placed = _numbered(ranked, [], cell, ["depth", "source", "shuffled", "doc_id", "size", "text_crc32"], "place")
    count = max(ranked.count(), 1)
    # Shard s takes the places from ceil(s * count / shards) on.
    placed = placed.withColumn("shard", F.expr(f"cast((place * {shards}) div {count} as int)"))
    first = F.expr(f"(shard * {count}L + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id",
        F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)).alias("source"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("place") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
