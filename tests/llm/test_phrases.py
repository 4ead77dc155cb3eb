import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from corpusterms.llm import phrases
from corpusterms.llm import quotient_filter as qf
from corpusterms.llm.queries import ORACLE, QUERIES

from .conftest import SF

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(texts, least=10, top=2000, cover=50):
    """By the definition, phrase by phrase."""
    counts, totals = {}, Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(UP, LOW))):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(words)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[words[i : i + n]] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(p) == 2 and len(q) == 3 and p in (q[:2], q[1:])]
            if any(100 * b >= cover * a for b in longer):
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def test_permutation_is_invertible_and_spreads():
    rnd = np.random.default_rng(0)
    for width in (40, 43, 64):
        for n in (2, 3):
            keys = [rnd.integers(0, 2**63, 1000, dtype=np.uint64) >> np.uint64(64 - width) for _ in range(n)]
            there = qf.permuted(keys, width)
            assert all((k < 2**width).all() if width < 64 else True for k in there)
            for a, b in zip(keys, qf.restored(there, width), strict=True):
                assert (a == b).all()
    same = [np.zeros(4096, np.uint64), np.arange(4096, dtype=np.uint64)]  # one first word
    top = qf.permuted(same, 40)[0] >> np.uint64(36)
    assert np.bincount(top.astype(int), minlength=16).max() < 2 * 4096 / 16


@pytest.mark.parametrize("shared", [0, 3])
@pytest.mark.parametrize("n", [2, 3])
def test_filters_are_lossless_and_merge(n, shared):
    rnd = random.Random(n)
    width, total, blobs = 40, Counter(), {}
    for _ in range(5):
        bag = Counter(tuple(rnd.randrange(8) for _ in range(n)) for _ in range(rnd.choice([1, 40, 3000])))
        bag[(1,) * n] += rnd.choice([1, 254, 255, 256, 10**12])
        total += bag
        keys = [np.array([k[i] for k in bag], np.uint64) for i in range(n)]
        keys, counts = qf.merged(qf.permuted(keys, width), np.array(list(bag.values()), np.int64))
        for bucket, raw in qf.split(keys, counts, width, shared):
            blobs.setdefault(bucket, []).append(raw)
    found = Counter()
    for bucket, raws in blobs.items():
        loaded = [qf.load(r, n, width, shared) for r in raws]
        keys, counts = qf.merged([np.concatenate([k[i] for k, _ in loaded]) for i in range(n)], np.concatenate([c for _, c in loaded]))
        assert (keys[0] >> np.uint64(width - shared) == bucket).all() if shared else bucket == 0
        for key in zip(*[k.tolist() for k in qf.restored(keys, width)], counts.tolist(), strict=True):
            assert key[:-1] not in found
            found[key[:-1]] = key[-1]
    assert found == total


def test_order_with_many_ties():
    rnd = np.random.default_rng(1)
    keys = [rnd.integers(0, 4, 5000).astype(np.uint64) for _ in range(3)]
    by = qf.order(keys)
    rows = [tuple(int(k[i]) for k in keys) for i in by]
    assert rows == sorted(rows) and sorted(by.tolist()) == list(range(5000))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_a_shard_that_is_emptied_often_counts_the_same(n, monkeypatch):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["a", "B", "c.", "d\n", ",e", "\tf", "."]) for _ in range(rnd.randrange(400))) for _ in range(20)]

    def counted():
        shard, out = phrases._Shard(n, 0, 64, None if n == 1 else phrases.Bits(np.full(1 << 17, 255, np.uint8))), Counter()
        for text in texts:
            for got in [*shard.add(b"en", text.encode())]:
                out += collect(got)
        return out + collect(shard.gathered())

    def collect(got):
        numbers, ids, _ = got
        if n == 1:
            return Counter(ids[numbers[numbers > 0]].tolist())
        if len(numbers) < n:
            return Counter()
        keys, counts = phrases._phrases(numbers, ids, n, None)
        return Counter(dict(zip(zip(*[k.tolist() for k in keys], strict=True), counts.tolist(), strict=True)))

    whole = counted()
    for name, value in (("SLICE", 7), ("GATHERED", 5), ("CHUNK", 3)):
        monkeypatch.setattr(phrases, name, value)
        assert counted() == whole
    assert sum(whole.values()) > 100


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_is_the_definition_and_the_sql(spark):
    texts = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows_of(QUERIES["op13_phrases"](spark, SF))
    assert got == brute(texts) and len(got) > 100
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.execute(ORACLE["op13_phrases"]).fetchall()) == got


def test_awkward_rows(documents, spark):
    texts = [(r.lang, r.text) for r in documents.collect()]
    for least, top in ((2, 50), (3, 5)):
        assert rows_of(phrases.collocations(documents, least=least, top=top)) == brute(texts, least, top)
    assert phrases.collocations(documents.limit(0)).collect() == []


def test_ties_languages_and_controls(spark):
    rows = [(lang, t) for lang in ("en", None, "und", "", "2:é") for t in ("É a a a a! b\x00c É\x1fA", "the of\tthe of; x y z x y z", "z", None, "", ".,;")]
    df = spark.createDataFrame(rows * 4, "lang string, text string").repartition(4)
    assert rows_of(phrases.collocations(df, least=3)) == brute(rows * 4, 3)


def test_widths_without_a_frequent_word_that_shares_its_id(spark, monkeypatch):
    rows = [("en", f"w{i} w{i} v{i % 7} w{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = rows_of(phrases.collocations(df, least=2))
    real = phrases.word_id
    # Ids that differ in their lowest bits only: small widths have clashes.
    monkeypatch.setattr(phrases, "word_id", lambda *a: real(*a) % (1 << 24) | 1 << 50)
    corpus = phrases._Corpus(df, 2)
    corpus.words()
    assert corpus.width > 40 and rows_of(phrases.collocations(df, least=2)) == want == brute(rows, 2)
