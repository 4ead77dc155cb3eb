import functools
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusterms.llm import best_fit, word_bpe
from corpusterms.llm.queries import QUERIES

from .conftest import SF

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def library():
    return Tokenizer.from_file(VOCABULARY)


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def brute(lengths, size):
    """Best fit decreasing, document by document, by a scan over all bins."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits)[1]] -= x
        else:
            rooms.append(size - x)
    return sorted(rooms)


def planned(lengths, size):
    totals = {x: lengths.count(x) for x in set(lengths)}
    runs = best_fit.plan(totals, size)
    bins = {}
    for length, total in totals.items():
        mine = runs[runs[:, 0] == length]
        for rank in range(total):
            _, first, b, each, offset = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
            nth = rank - first
            bins.setdefault(b + nth // each, []).append((offset + nth % each * length, length))
    for placed in bins.values():  # gapless from 0, within the size
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    return sorted(size - sum(x for _, x in p) for p in bins.values())


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    size = rnd.choice([1, 2, 7, 16, 64, 100])
    lengths = [min(size, max(1, int(rnd.choice([rnd.uniform(1, size), rnd.expovariate(5 / size), size])))) for _ in range(rnd.randrange(200))]
    assert planned(lengths, size) == brute(lengths, size)


def test_runs_stay_within_the_stated_bound():
    rnd = random.Random(1)
    for size in (64, 256):
        runs = best_fit.plan({x: rnd.randrange(1, 10**9) for x in range(1, size + 1)}, size)
        assert len(runs) <= 5 * size * (2 * size) ** 0.5


def test_words_give_the_librarys_ids():
    rnd = random.Random(3)
    marks = ["é", "́", "ΑΣ", "İ", "\x1c", "\x85", " ", "　", "'s", "don't", "A1b2", "<|endoftext|>", "<|startoftext|>x"]
    marks += ["DON'T", "<|EndOfText|>", "\"'s", "x'll''t", "_a-b'", "\x00", "12a", "#!?", "'", "é's", "'ÉS"]
    marks += ["한", "한", "🙂", "ß", "ﬁ", "\t", "\n", "\r\n", " ", "  ", "\x0b", "\x0c", "...", "a" * 100, "̈́"]
    table = word_bpe.words(VOCABULARY)
    for _ in range(400):
        text = "".join(rnd.choice(marks) + rnd.choice(["", "", " "]) for _ in range(rnd.randrange(12)))
        assert word_bpe.encode(table, text.encode()).tolist() == library_ids(text), repr(text)


def test_every_latin_character_and_sign_gives_the_librarys_ids():
    table = word_bpe.words(VOCABULARY)
    for c in [*map(chr, range(0x250)), "̈", "̸", "ﬀ", "Ⅷ", "²"]:
        for text in (c, f"a{c}b", f"{c}{c}", f"x {c}'s", f"É{c}", f"1{c}2", f"<{c}", f"{c} é"):
            assert word_bpe.encode(table, text.encode()).tolist() == library_ids(text), repr(text)


def test_files_of_other_rules_go_to_the_library(tmp_path):
    other = json.loads(open(VOCABULARY).read())
    other["normalizer"]["normalizers"].pop()
    path = tmp_path / "other.json"
    path.write_text(json.dumps(other))
    text = "Hello World, it's ÉTÉ"
    want = Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
    assert word_bpe.encode(word_bpe.Words(str(path)), text.encode()).tolist() == want != library_ids(text)


def test_slices_and_a_forgetting_table(monkeypatch):
    monkeypatch.setattr(word_bpe, "KEPT", 5)
    text = " ".join(f"word{i % 13} x\n" for i in range(500))
    table = word_bpe.Words(VOCABULARY)
    assert [i for s in word_bpe.slices(text.encode(), 100) for i in table.ids(s).tolist()] == library_ids(text)
    assert table.ruled and len(table.known) <= 18


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000 + "x", "a" * 200_000, "!" * 200_000])
def test_long_runs(text):
    assert word_bpe.encode(word_bpe.words(VOCABULARY), text.encode()).tolist() == library_ids(text)


def check(got, texts, size):
    bins, docs = {}, {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    lengths = []
    for key, text in texts:
        ids = np.array(library_ids(text) + [0], "<u4")
        for number, start in enumerate(range(0, len(ids), size)):
            part = ids[start : start + size]
            lengths.append(len(part))
            assert any(
                (r.piece, r.start, r.length, r.ids_crc32) == (number, start, len(part), zlib.crc32(part.tobytes()))
                for r in docs[key]
            )
    assert len(got) == len(lengths) and len(bins) == len(brute(lengths, size))


def test_query_against_the_library(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(QUERIES["op12_best_fit"](spark, SF).collect(), texts, 2048)


def test_awkward_rows_and_many_tasks(documents, rows):
    from pyspark.sql import functions as F

    packed = best_fit.pack_documents(documents, VOCABULARY, size=64)
    check(packed.withColumn("ids_crc32", F.crc32("ids")).collect(), rows, 64)
    assert packed.columns == ["length", "doc_id", "piece", "start", "ids", "sequence_id", "offset"]
    assert best_fit.pack_documents(documents.limit(0), VOCABULARY).collect() == []


def test_null_ids_and_a_hot_length(spark):
    rows = [(None if i % 3 == 0 else 7, "one two three" if i % 2 else None) for i in range(100)]
    got = best_fit.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), VOCABULARY, size=9)
    got = got.collect()
    assert len(got) == 100 and sum(r.doc_id is None for r in got) == 34
    assert len({r.sequence_id for r in got}) == len(brute([4] * 50 + [1] * 50, 9))
