"""Exact deduplication by content-defined chunk recipes (native).

Every normalised text is cut into chunks at places that depend on its
content alone.  Chunks are deduplicated to identifiers that are verified
against the chunk text: a chunk's identifier is its 64-bit hash and, only
where two different chunk texts share a hash, its rank among them.  A
document is then its recipe, the ordered list of chunk identifiers; two texts
are equal exactly when their recipes are.  Text moves once, chunk by chunk,
combined on the map side (a chunk repeated in a task is sent once); all later
steps move recipes, 8 bytes a chunk.

Defined results: a null text counts as empty; empty texts are equal to one
another (empty recipe); a text of white space alone is one space; repeated
``doc_id``s are rows like any other and count in ``group_size`` (order is by
``doc_id`` alone, so rows that share the smallest one are all marked kept); a
null ``doc_id`` sorts after every other; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_rows, scratch, stored

WHITE = r"[\x20\x09-\x0D]+"
#: Where a text may be cut, in its UTF-8 bytes, so that one pattern serves every
#: script: where a word ends in one of a few Latin letters and the next starts
#: with one of a few others; behind two characters beyond ASCII whose last bytes
#: are among eight of 64; behind a digit or a rare letter and another one (tables,
#: codes).  Each happens every few hundred bytes of such text.
LAST = r"[\x83\x8B\x93\x9B\xA3\xAB\xB3\xBB]"
CUTS = (
    r"(?<=[dnrstDNRST] )(?=[acdehiostACDEHIOST])",
    rf"(?<={LAST}[\xC2-\xF4][\x80-\xBF]{{0,2}}{LAST})(?![\x80-\xBF])",
    r"(?<=[0-9qxzQXZ][37jkvxzJKVXZ])",
)
#: A chunk: 256 to 4096 bytes, ended at the first place for a cut.
CHUNK = rf"(?s).{{256,4096}}?(?:{'|'.join(CUTS)})|.{{1,4096}}"


def normalised(text):
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def chunks(text):
    """The text's UTF-8 bytes as an array of chunks (binary)."""
    octets = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    cut = F.regexp_extract_all(octets, F.lit(CHUNK), F.lit(0))
    return F.transform(cut, lambda c: F.encode(c, "ISO-8859-1"))


def _clash_ranks(cut: DataFrame, clashes: DataFrame) -> DataFrame:
    """``(doc_id, text_sha256, recipe)`` where chunk texts share hashes."""
    spots = cut.select(
        "doc_id", "text_sha256", F.posexplode(F.arrays_zip("hashes", "chunks")).alias("pos", "z")
    ).select("doc_id", "text_sha256", "pos", F.col("z.hashes").alias("h"), F.col("z.chunks").alias("c"))
    ranks = clashes.select("h", F.posexplode(F.array_sort("texts")).alias("r", "c"))
    named = spots.distinct().join(ranks, ["h", "c"], "left")
    item = F.struct("pos", "h", F.coalesce("r", F.lit(0)).alias("r"))
    listed = named.groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_list(item)).alias("items"))
    recipe = F.transform("items", lambda i: F.struct(i["h"].alias("h"), i["r"].alias("r")))
    rows = cut.select("doc_id", "text_sha256")
    listed = listed.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), recipe.alias("recipe"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha256") == F.col("sha"))
    return rows.join(listed, same, "left").select(
        "doc_id", "text_sha256", F.coalesce("recipe", F.array().cast("array<struct<h:bigint,r:int>>")).alias("recipe")
    )


def recipes(docs: DataFrame, hash_bits: int = 64, path: str | None = None) -> DataFrame:
    """``(doc_id, text_sha256, recipe array<struct<h, r>>)`` of every row.

    ``hash_bits`` shortens the chunk hash (tests use it to force clashes).
    """
    path = path or scratch(docs.sparkSession)

    def chunk_hash(c):
        return F.shiftrightunsigned(F.xxhash64(c), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(c)

    cut = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("t"))
        .select(
            "doc_id",
            F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"),
            chunks(F.col("t")).alias("chunks"),
        )
        .withColumn("hashes", F.transform("chunks", chunk_hash))
    )
    # Distinct chunks, compared byte by byte; then the hashes of more than one.
    distinct = cut.select(F.explode("chunks").alias("c")).select(chunk_hash(F.col("c")).alias("h"), "c").distinct()
    many = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    many = stored(many, f"{path}/clashing_hashes")
    if many.isEmpty():
        recipe = F.transform("hashes", lambda h: F.struct(h.alias("h"), F.lit(0).alias("r")))
        return stored(cut.select("doc_id", "text_sha256", recipe.alias("recipe")), f"{path}/recipes")
    clashes = distinct.join(many, "h").groupBy("h").agg(F.collect_set("c").alias("texts"))
    return stored(_clash_ranks(cut, clashes), f"{path}/recipes")


def exact_groups(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, a row per row."""
    path = scratch(docs.sparkSession)
    listed = recipes(docs, hash_bits, path)
    groups = (
        listed.groupBy("recipe")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    # A stored side: AQE can then split the partition of a very large group.
    groups = stored(groups, f"{path}/groups")
    out = listed.join(groups, "recipe", "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns."""
    return least_rows(docs, lambda rows: exact_groups(rows).select("doc_id", F.col("keep_id").alias("group")))
