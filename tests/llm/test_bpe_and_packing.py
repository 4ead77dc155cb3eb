import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusterms.llm import byte_bpe, packing
from corpusterms.llm.queries import packed_pieces

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


def test_round_trip_and_ids(documents, rows):
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.rank_table(MULTI), special_tokens={})
    out = byte_bpe.encode_column(documents.select("doc_id", "text"), MULTI, P.PATTERN)
    got = sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in byte_bpe.decode_column(out, MULTI, P.PATTERN).collect())
    want = [(d, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in rows]
    assert got == sorted(want)
    assert byte_bpe.encode_column(documents.select("doc_id", "text").limit(0), MULTI, P.PATTERN).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab Zé²٣ \n\t'.!漢s_1", max_size=80))
def test_safe_boundaries(text):
    enc = byte_bpe.encoding(MULTI, P.PATTERN)
    cut = list(byte_bpe.pieces(text, 3))
    assert "".join(cut) == text
    assert [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


@pytest.mark.parametrize("path", [MULTI, P.path("byte_bpe_50k.json")])
@pytest.mark.parametrize("space", [" ", "\n", "\u00a0", " \n\t", "\u3000\r\n"])
@pytest.mark.parametrize("behind", ["", "x", "x y", " 1", "!", "'s", "\x1c"])
def test_white_space_runs_of_every_kind(path, space, behind):
    enc = byte_bpe.encoding(path, P.PATTERN)
    for many in (999, 1000, 1001, 5000):
        for front in ("", "a", "\x1f", "漢"):
            text = front + space * many + behind + space * many
            assert byte_bpe.encode(enc, text).tolist() == enc.encode_ordinary(text)


@pytest.mark.parametrize("behind", ["", "word", "\nword"])
@pytest.mark.parametrize("space", [" ", "\n"])
def test_white_space_by_the_million(space, behind):
    text = space * 3_000_000 + behind
    path = P.path("byte_bpe_50k.json")
    ids = byte_bpe.encode(byte_bpe.encoding(path, P.PATTERN), text)
    assert ids.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    multi = byte_bpe.encoding(MULTI, P.PATTERN)
    assert multi.decode(byte_bpe.encode(multi, text).tolist()) == text


def test_json_and_special_strings():
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    enc = byte_bpe.encoding(path, P.PATTERN)
    for text in ["<|endoftext|> it's  fine\n\n", "naïve 漢字 ²³ \x00\xad\xa0x", "a" * 3000, "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16")]:
        assert byte_bpe.encode(enc, text).tolist() == t.encode(text, add_special_tokens=False).ids


def check_packing(got, rows, held_tokens=None):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = defaultdict(list)
    for d, text in rows:
        want[d].append(t.encode(text or "", add_special_tokens=False).ids + [0])
    pieces, spots = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        spots[r.sequence_id].append((r.offset, r.length))
    for d, lists in want.items():
        ids = lists[0]
        found = sorted(pieces[d], key=lambda r: r.start)
        starts = [r.start for r in found]
        assert sum(r.length for r in found) == len(ids) * len(lists)
        for r in found:
            assert r.doc_tokens == len(ids)
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert sorted(set(starts)) == list(range(0, len(ids), 1024))
    for found in spots.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing(documents, rows):
    got = packed_pieces(documents).collect()
    check_packing(got, rows)
    assert {r.doc_id for r in got} == {d for d, _ in rows}
    assert packed_pieces(documents.limit(0)).collect() == []


def test_packing_in_batches(documents, rows):
    path = P.path("byte_bpe_50k.json")
    got = packing.pack_documents(documents, path, P.PATTERN, held=3000).withColumn("ids_crc32", F.crc32("ids"))
    check_packing(got.collect(), rows)


def test_packed_ids_are_the_library_s(spark):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"{mark}{mark} it's", f"word{mark}word <|endoftext", f"{mark}\n\n", "plain"]
    texts.append(("some words " * 5000 + mark) * 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = defaultdict(dict)
    for r in packing.pack_documents(docs, path, P.PATTERN).collect():
        found[r.doc_id][r.start] = np.frombuffer(bytes(r.ids), "<u4").tolist()
    for d, text in enumerate(texts):
        ids = [i for _, part in sorted(found[d].items()) for i in part]
        assert ids == t.encode(text, add_special_tokens=False).ids + [0]


def test_best_fit_is_tightest():
    rnd = np.random.default_rng(1)
    lengths = rnd.integers(1, 65, 400)
    window, offset, opened = packing.best_fit(lengths, 64)
    room = []  # the same, by looking at every open window
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - lengths[i])
        else:
            room.append(64 - lengths[i])
    left = [64 - lengths[window == w].sum() for w in range(opened)]
    assert sorted(left) == sorted(room)
    assert min(left) >= 0 and all(offset >= 0)


def test_padding_rule():
    assert [packing.padded(n, 1024) for n in (1, 2, 3, 512, 513, 1024)] == [1, 2, 1024, 512, 1024, 1024]


def test_digest_query(spark):
    from corpusterms.llm.queries import QUERIES

    from .conftest import SF

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op7_byte_bpe"](spark, SF).collect():
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
