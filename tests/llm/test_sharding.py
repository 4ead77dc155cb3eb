import zlib
from collections import Counter, defaultdict

from corpusterms.llm import sharding

from .conftest import SF


def brute_places(rows, key):
    """(fractional rank, source) order by its definition."""
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    out = []
    for source, own in by.items():
        own.sort(key=key)
        out += [((i + 0.5) / len(own), "" if source is None else "=" + source, key(r), r) for i, r in enumerate(own)]
    return [x[3] for x in sorted(out, key=lambda x: x[:3])]


def test_law_and_digests(documents):
    given = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in documents.collect())
    got = sharding.interleaved_shards(documents, shards=8).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == given
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.interleaved_shards(documents.limit(0)).collect() == []


def test_order_by_definition_and_mixture(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id").alias("h")).collect()}
    got = sorted(sharding.interleaved_shards(docs).collect(), key=lambda r: (r.shard, r.slot))
    want = brute_places(got, lambda r: (hashes[r.doc_id], r.doc_id))
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    total = Counter(r.source for r in got)
    for shard in range(8):
        own = Counter(r.source for r in got if r.shard == shard)
        # every shard holds each source's share of it, give or take one row
        assert all(abs(own[s] - total[s] / 8) <= 2 for s in total)
