"""An index of document keys: which of very many keys a batch may hold.

Keys lie in buckets by their hash, a folder each; beside them a Bloom filter in
rows: ``word`` (64 bits, two keys each on average) and its ``bits``, of which a
key sets six.  A batch joins its keys with the filter's words, and reads the
buckets in which the filter has one of them: for a batch of new documents next
to none, about one for every few thousand keys by mistake.  The filter never misses a
key, so an anti join with what ``known`` returns is exact.

Defined results: a null key is in no index (it equals no other); repeated keys
are stored once; an index of no keys knows none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys for each word of the filter, bits a key sets, keys a bucket holds.
KEYS_A_WORD, BITS, BUCKET_KEYS = 2, 6, 1_000_000
LEAST_BUCKETS = 64


def _marked(keys: DataFrame, words: int, buckets: int) -> DataFrame:
    """``(document, word, mask, bucket)``: a word lies in one bucket, with all its keys."""
    key = F.col("document")
    places = F.xxhash64(key, F.lit("bits"))
    bits = [
        F.shiftright(places, 6 * i).bitwiseAND(F.lit(63)).cast("int").alias(f"b{i}") for i in range(BITS)
    ]
    at = keys.select("document", F.pmod(F.xxhash64(key), F.lit(words).cast("long")).alias("word"), *bits)
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.expr(f"shiftleft(1L, b{i})") for i in range(BITS)])
    return at.select("document", "word", mask.alias("mask"), F.pmod("word", F.lit(buckets)).alias("bucket"))


def build(keys: DataFrame, path: str, buckets: int | None = None) -> dict[str, int]:
    """Write the index of ``keys`` (a column ``document``) to ``path``.

    Returns its measures, which ``known`` needs.  ``buckets`` is one for a
    million keys, 64 at least, unless given.
    """
    rows = keys.select("document").where("document IS NOT NULL").distinct()
    n = rows.count()
    buckets = buckets or max(LEAST_BUCKETS, -(-n // BUCKET_KEYS))
    words = max(buckets, -(-n // KEYS_A_WORD))
    marked = _marked(rows, words, buckets)
    dealt = marked.select("document", "bucket").repartition("bucket").sortWithinPartitions("bucket", "document")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys")
    bits = marked.groupBy("word").agg(F.bit_or("mask").alias("bits"))
    bits.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/filter")
    return {"words": words, "buckets": buckets, "keys": n}


def hit_buckets(keys: DataFrame, path: str, measures: dict[str, int]) -> list[int]:
    """The buckets that may hold one of ``keys``: at most all of them, integers."""
    spark = keys.sparkSession
    bits = spark.read.schema("word long, bits long").parquet(f"{path}/filter")
    probe = _marked(keys.where("document IS NOT NULL"), measures["words"], measures["buckets"])
    hits = probe.join(bits, "word").where("bits & mask = mask").select("bucket").distinct()
    return sorted(r.bucket for r in hits.collect())


def known(keys: DataFrame, path: str, measures: dict[str, int]) -> DataFrame:
    """``(document)``: the indexed keys of every bucket that may hold one of ``keys``.

    Runs a job (the look-up in the filter) when called; the rows come from the
    folders of those buckets only.
    """
    spark = keys.sparkSession
    kind = keys.schema["document"].dataType.simpleString()
    if not measures["keys"]:
        return spark.createDataFrame([], f"document {kind}")
    rows = spark.read.schema(f"document {kind}, bucket long").parquet(f"{path}/keys")
    return rows.where(F.col("bucket").isin(hit_buckets(keys, path, measures))).select("document")


def indexed_new_documents(corpus: DataFrame, path: str, measures: dict[str, int]) -> DataFrame:
    """Rows of ``corpus`` whose document is not in the index (all columns kept)."""
    return corpus.join(known(corpus.select("document"), path, measures), "document", "left_anti")
