import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusterms.llm import exact_dedup

from .conftest import same


def brute(rows):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    by = {}
    for d, t in norm:
        by.setdefault(t, []).append(d)
    return [
        (d, min(by[t]), len(by[t]), d == min(by[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm
    ]


@pytest.mark.parametrize("bits", [64, 3])  # 3: nearly every chunk's hash clashes with another's
def test_groups(documents, rows, bits):
    same(exact_dedup.exact_groups(documents, hash_bits=bits), brute(rows))


def test_chunks_rebuild_the_text(documents, rows, spark):
    cut = documents.select("text", F.regexp_extract_all("text", F.lit(exact_dedup.CHUNK), F.lit(0)).alias("c"))
    for r in cut.where("text is not null").collect():
        assert "".join(r.c) == r.text and all(len(c) <= 4096 for c in r.c)


def test_chunks_are_the_bytes_of_the_text(documents):
    got = documents.select("text", exact_dedup.chunks(F.col("text")).alias("c")).where("text is not null").collect()
    for r in got:
        assert b"".join(bytes(c) for c in r.c) == r.text.encode() and all(len(c) <= 4096 for c in r.c)


def _prose(letters, seed, n=9000):
    draw = random.Random(seed)
    words = ("".join(draw.choices(letters, k=draw.randint(2, 9))) for _ in range(n))
    return " ".join(words)


SCRIPTS = {
    "latin": _prose("eeeettaaooiinnsshhrrddlluccmwfgypbvk", 1),
    "upper": _prose("EEEETTAAOOIINNSSHHRRDDLLUCCMWFGYPBVK", 2),
    "cyrillic": _prose("ооооееееааааииинннтттсссрррвввлллккмммдддпппууяыьгзбчйхжш", 3),
    "greek": _prose("ααααοοοιιιεεετττσσννηυρππκκμλωδγχθφβξζψ", 4),
    "han": "".join(random.Random(5).choices([chr(c) for c in range(0x4E00, 0x6000)], k=30000)),
    "kana": "".join(random.Random(6).choices([chr(c) for c in range(0x3042, 0x3094)], k=30000)),
    "devanagari": _prose([chr(c) for c in range(0x0905, 0x094D)], 7),
    "hangul": "".join(random.Random(8).choices([chr(c) for c in range(0xAC00, 0xC000)], k=30000)),
    "numbers": ",".join(str(random.Random(9 + i).randint(0, 10**6)) for i in range(9000)),
}


def test_an_insertion_changes_few_chunks_in_any_script(spark):
    pairs = [(name, text, "\u00e9a" + text[:20000] + "b" + text[20000:]) for name, text in SCRIPTS.items()]
    df = spark.createDataFrame(pairs, "name string, a string, b string")
    got = df.select("name", exact_dedup.chunks(F.col("a")).alias("a"), exact_dedup.chunks(F.col("b")).alias("b"))
    for r in got.collect():
        a, b = ({bytes(c) for c in x} for x in (r.a, r.b))
        assert len(a) > 15 and len(a - b) <= 8, (r.name, len(a), len(a - b))


def test_dropping_keeps_columns_and_is_native(documents, rows):
    kept = exact_dedup.drop_copies(documents)
    assert kept.columns == documents.columns
    keep = {d for d, k, *_ in brute(rows) if d == k}
    assert {r.doc_id for r in kept.collect()} == keep
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(documents):
    assert exact_dedup.exact_groups(documents.limit(0)).collect() == []


def test_null_and_repeated_ids(spark):
    long = ["".join(f"{w} word{i} stands here. " for i in range(300)) for w in ("one", "two", "three")]
    rows = [(None, long[0], "a"), (None, long[1], "b"), (None, long[1], "c"), (7, long[2], "d"), (7, "alone", "e")]
    rows += [(3, long[2], "f"), (9, "twice", "g"), (9, "twice", "g"), (None, "twice", "h"), (None, None, "i"), (4, "", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted((r.doc_id or -1, r.text, r.source) for r in exact_dedup.drop_copies(docs).collect())
    assert {x[2] for x in got} - {"b", "c"} == {"a", "e", "f", "g", "j"} and len(got) == 6
    for bits in (64, 3):
        sizes = {(r.doc_id, r.text_sha256): r.group_size for r in exact_dedup.exact_groups(docs, bits).collect()}
        sha = [hashlib.sha256(re.sub(" +", " ", t).encode()).hexdigest() for t in long]
        assert [sizes[None, sha[0]], sizes[None, sha[1]], sizes[7, sha[2]]] == [1, 2, 2]
