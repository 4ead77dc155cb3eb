import hashlib
import random
import struct

import xxhash
from pyspark.sql import functions as F

from corpusterms.llm import winnowing
from corpusterms.llm.queries import QUERIES

from .conftest import SF


def _signed(x):
    return x - 2**64 if x >= 2**63 else x


def _hash_longs(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v), seed=seed).intdigest()
    return seed


def cut(text):
    """Units, character by character."""
    single = [(0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x31F0, 0x31FF)]
    single += [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
    out, now = [], ""
    for c in text + " ":
        alone = any(a <= ord(c) <= b for a, b in single)
        if now and (alone or c in " \t\n\v\f\r" or (len(now) == 5 and c not in winnowing.CUTS)):
            out.append(now)
            now = ""
        if alone:
            out.append(c)
        elif c in winnowing.CUTS:
            out.append(now + c)
            now = ""
        elif c not in " \t\n\v\f\r":
            now += c
    return out


def brute(text, k=winnowing.K, w=winnowing.W):
    units = [_signed(xxhash.xxh64(u.encode(), seed=42).intdigest()) for u in cut(text.lower())]
    if not units:
        return []
    grams = [_hash_longs(units[i : i + k]) >> 32 for i in range(max(1, len(units) - k + 1))]
    if len(units) < k:
        grams = [_hash_longs(units) >> 32]
    chosen = []
    for i in range(max(1, len(grams) - w + 1)):
        window = grams[i : i + w]
        place = max(j for j in range(len(window)) if window[j] == min(window)) + i
        if place not in chosen[-w:]:
            chosen.append(place)
    return [(p, grams[p]) for p in chosen]


def spelled(marks):
    return " ".join(f"{p:X}:{h:X}" for p, h in marks)


def jaccard(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_by_definition(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    got = {r.doc_id: r for r in QUERIES["op10_winnowing"](spark, SF).collect()}
    for i, d in enumerate(order):
        text, after = docs[d], docs[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = brute(text), brute(edited), brute(after)
        assert r.fingerprint == spelled(a) and r.edited_fingerprint == spelled(b)
        assert abs(r.near_edited - jaccard(a, b)) < 1e-12 and abs(r.near_next - jaccard(a, c)) < 1e-12


def test_awkward_rows(documents, rows):
    got = documents.select("doc_id", "text", winnowing.spelled(winnowing.winnow(F.coalesce("text", F.lit("")))).alias("f"))
    for r in got.collect():
        assert r.f == spelled(brute(r.text or ""))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def following(pairs):
    """(doc_id, text, the next one's text) as a bag."""
    return sorted(((r.doc_id, r.text, r.next_row.text) for r in pairs), key=repr)


def by_definition(rows):
    def key(r):
        h = _signed(xxhash.xxh64(r[1].encode(), seed=42).intdigest())
        return (r[0] is None, -(r[0] or 0), h)

    order = sorted(rows, key=key)
    return sorted(((*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order)), key=repr)


def test_next_goes_round_over_ranges(documents, rows):
    given = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    want = by_definition([(d, t or "") for d, t in rows])
    for size in (1, 4, 1000):
        assert following(winnowing.with_next(given, rows_per_range=size).collect()) == want
    assert winnowing.with_edits(documents.limit(0)).collect() == []


def test_any_ids(spark):
    ends = [(-(2**63), "a"), (5, "b"), (2**63 - 1, "c"), (None, "d"), (0, "e")]
    outlier = [(i, f"t{i}") for i in range(300)] + [(2**62, "far")]
    hot = [(7, f"t{i % 50}") for i in range(200)] + [(None, "same")] * 200 + [(i, "") for i in range(100)]
    for case in (ends, outlier, hot, hot[200:]):
        df = spark.createDataFrame(case, "doc_id long, text string").repartition(3)
        for size in (1, 20, 1000):
            assert following(winnowing.with_next(df, rows_per_range=size).collect()) == by_definition(case)


def test_one_row_is_its_own_next(spark):
    one = spark.createDataFrame([(5, "abcdef"), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r.edited for r in winnowing.with_edits(one).collect()}
    assert got == {5: "abc", None: ""}
    alone = winnowing.with_edits(one.where("doc_id = 5")).first()
    assert alone.edited == "abcabc"


def test_shared_passage_is_found(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    df = spark.createDataFrame([("xx yy " + passage, passage + " zz qq ww")], "a string, b string")
    assert df.select(winnowing.likeness(winnowing.winnow(F.col("a")), winnowing.winnow(F.col("b"))).alias("j")).first().j > 0.5


def test_shared_text_is_found_at_every_alignment(spark):
    rnd = random.Random(2)
    han = "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(500))
    thai = "".join(chr(rnd.randrange(0x0E01, 0x0E2E)) for _ in range(500))
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(rnd.choices(x, k=500)) for x in (letters, letters.upper(), "0123456789abcdef", "0123456789")]
    cyrillic = "".join(chr(rnd.randrange(0x430, 0x450)) for _ in range(500))
    rows = [(t[::-1][:s] + t, t) for t in (han, thai, cyrillic, *tokens) for s in range(9)]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = (winnowing.winnow(F.col(c)) for c in "ab")
    got = [r.j for r in df.select(winnowing.likeness(a, b).alias("j")).collect()]
    assert len(got) == 63 and min(got) > 0.8


def test_a_character_more_changes_little_whatever_the_length(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n)) for n in (60, 64, 65, 66, 200)]
    df = spark.createDataFrame([(" ".join(words), " ".join("x" + w for w in words))], "a string, b string")
    a, b = (winnowing.winnow(F.col(c)) for c in "ab")
    assert df.select(winnowing.likeness(a, b).alias("j")).first().j > 0.5


def test_units_by_definition(spark):
    rnd = random.Random(4)
    signs = "abst37.é漢\u0e01\u0442ж \t\n\u00a0\U00020001\U0001f642"
    texts = ["".join(rnd.choices(signs, k=rnd.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", winnowing.units(F.col("t")).alias("u")).collect():
        assert r.u == cut(r.t)
