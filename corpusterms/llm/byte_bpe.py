"""Byte-level BPE encoding and decoding with a local rank file.

The tiktoken library encodes each text inside Arrow batches; the rank file is
read once per Python worker.  A long text is first cut at *safe boundaries*:
places where the split pattern is bound to end a match whatever stands
around, so that encoding the pieces one by one gives the ids of the whole.
Decoding puts the raw bytes of the ids together (an id may end inside a
character, so no text is decoded before the end).

Defined results: a null text counts as empty and has no ids; strings that
look like special tokens are ordinary text, unless the added tokens of a JSON
file are given to ``encode``, which then have their own ids; repeated rows are encoded each;
an empty table gives no rows; the ``ids`` are little-endian unsigned 32-bit
integers in a binary column, so they cross to the JVM without a copy per id.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, worker_cache

#: Characters of a text that are encoded at once.
PIECE = 65_536


def rank_table(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file, or of a byte-level BPE ``.json`` whose ids are its ranks."""
    with open(path, "rb") as f:  # installed on every worker, like the library
        raw = f.read()
    if path.endswith(".tiktoken"):
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
    # The JSON form spells bytes as printable characters: the printable Latin-1
    # ones as themselves, the others as the characters from U+0100 on, in order.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    spelled = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    spec = json.loads(raw)
    special = {t["id"] for t in spec.get("added_tokens", ())}
    vocab = spec["model"]["vocab"]
    return {bytes(spelled[c] for c in word): i for word, i in vocab.items() if i not in special}


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, kept by the worker."""
    import tiktoken

    cache = worker_cache()
    key = ("byte_bpe", path, pattern)
    if key not in cache:
        cache[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=rank_table(path), special_tokens={})
    return cache[key]


def added_tokens(path: str) -> dict[str, int]:
    """The ids of the added tokens of a ``.json`` file, kept by the worker."""
    cache = worker_cache()
    key = ("added_tokens", path)
    if key not in cache:
        given = []
        if path.endswith(".json"):
            with open(path, "rb") as f:
                given = json.load(f).get("added_tokens", ())
        for t in given:
            if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
                raise ValueError(f"added token {t['content']!r} takes in what stands around it")
        cache[key] = {t["content"]: t["id"] for t in given}
    return cache[key]


#: Between a letter and a following space that a letter follows: a run of
#: letters ends before the space, and the space goes with the letters behind
#: it, whatever stands further left or right.
_SAFE = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` cut at safe boundaries, ``size`` characters or more each."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


#: White space of the split patterns, more of it in a row than their look-ahead
#: is trusted with: the run is a match but for its last character, which goes
#: with what follows (at the end of a text the run is whole).
_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")


def _encoded(enc, text: str) -> Iterator[np.ndarray]:
    at = 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        for p in pieces(text[at : run.start()]):
            yield enc.encode_to_numpy(p, disallowed_special=())
        # One match, and so one piece of the merges: the library's call for that.
        yield np.array(enc._encode_single_piece(text[run.start() : end]), np.uint32)
        at = end
    for p in pieces(text[at:] if at else text):
        yield enc.encode_to_numpy(p, disallowed_special=())


def encode(enc, text: str | None, added: dict[str, int] | None = None) -> np.ndarray:
    """The ids of a whole text; ``added`` tokens part it and have ids of their own."""
    parts = [text or ""]
    if added and any(a in parts[0] for a in added):
        longest = sorted(added, key=len, reverse=True)
        parts = re.split("(" + "|".join(map(re.escape, longest)) + ")", parts[0])
    found = []
    for i, part in enumerate(parts):
        if i % 2:
            found.append(np.array([added[part]], np.uint32))
        else:
            found += _encoded(enc, part)
    if not found:
        return np.empty(0, np.uint32)
    return (found[0] if len(found) == 1 else np.concatenate(found)).astype("<u4", copy=False)


def _batches(column: pa.Array, width: int):
    """Row ranges of a column of at most about ``width`` characters each."""
    at, held = 0, 0
    for i, t in enumerate(column):
        held += len(t.as_buffer()) if t.is_valid else 0
        if held >= width:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(column):
        yield at, len(column)


def encode_column(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows of ``docs(key, text)`` as ``(key, ids binary)``, in their order."""
    key = next(c for c in docs.columns if c != text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            for lo, hi in _batches(texts, 8 << 20):
                ids = [encode(enc, t.as_py()).tobytes() for t in texts[lo:hi]]
                yield pa.RecordBatch.from_arrays([keys[lo:hi], pa.array(ids, pa.binary())], [key, "ids"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, ids binary")


def decode_column(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``(key, ids, decoded binary)``: the raw bytes of the ids."""
    key = next(c for c in encoded.columns if c != "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for b in batches:
            keys, ids = b.column(0), b.column(1)
            for lo, hi in _batches(ids, 8 << 20):
                raw = [enc.decode_bytes(np.frombuffer(x.as_buffer(), "<u4").tolist()) for x in ids[lo:hi]]
                cols = [keys[lo:hi], ids[lo:hi], pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [key, "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, ids binary, decoded binary")
