"""Grouping spelling variants by bidirectional FM-index search schemes.

1. *Words.*  Tasks count the runs of letters of whole texts; only A-Z are
   lower-cased.  The counts per word are summed, the frequent words stored.
2. *Shards.*  Of two words one edit apart, the other holds the first or the
   second half of the one unchanged, at the same end.  Every word goes to the
   shards of its halves: as a query by its own halves, and to be found by what
   are the halves of words of its length, a character less or more.  Whatever
   is near a query is in the same shard.  Where more words share a half than a
   shard should hold, the rest of the word is halved again (the edit is in one
   of its halves, the other is unchanged), and so on, so no shard grows with
   the number of words that begin or end alike.
3. *Search.*  A task builds the bidirectional index of its shard's words and
   runs the search scheme for one error (``fm_index``).  It passes on, per
   query, the number of near words and the most frequent of them.  A pair that
   more than one half leads to counts at the first.
4. *Forms.*  A word's form is its most frequent near word, if that is at least
   ``ratio`` times as frequent.  Frequencies grow along the forms, so chains
   are short; pointers are doubled until all show at their roots.

Defined results: a null or empty text has no words; a null ``doc_id`` counts
as empty where words are made; repeated rows count each; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fm_index
from .common import bounded_batches, parts, scratch, stored

_RUN = re.compile("[a-zÀ-ÿ]+")
_OTHER = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
#: Bytes of a text that are split at once.
SLICE = 1 << 20
#: Different words, and their characters, that a task counts before it passes them on.
HELD, HELD_CHARS = 300_000, 32 << 20
#: Characters of words in a shard, on average and (but for few words) at most.
SHARD, CROWD = 1_000_000, 2_000_000


def _slices(text: bytes) -> Iterator[bytes]:
    """``text`` cut between runs, ``SLICE`` bytes or more each but the last."""
    at = 0
    while len(text) - at > SLICE:
        cut = _OTHER.search(text, at + SLICE)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def altered(word: str, key: int, every: int) -> str:
    """``word`` without one code point, if ``every`` divides the key."""
    if key % every:
        return word
    at = key % len(word)
    return word[:at] + word[at + 1 :]


def _count(least_chars: int, every: int | None):
    def batch(held: Counter) -> pa.RecordBatch:
        cols = [pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = Counter(), 0
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                if not text.is_valid:
                    continue
                front = zlib.crc32(b"%s:" % doc_id.as_py().encode())
                for part in _slices(text.as_buffer().to_pybytes().lower()):
                    for word, n in Counter(_RUN.findall(part.decode())).items():
                        if len(word) < least_chars:
                            continue
                        if every:
                            word = altered(word, zlib.crc32(word.encode(), front), every)
                            if len(word) < least_chars:
                                continue
                        if word not in held:
                            chars += len(word)
                        held[word] += n
                    if len(held) >= HELD or chars >= HELD_CHARS:
                        yield batch(held)
                        held, chars = Counter(), 0
        if held:
            yield batch(held)

    return run


def vocabulary(docs: DataFrame, least_chars: int = 5, least: int = 3, every: int | None = 97) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough.

    With ``every``, a word of a document loses a code point where the number
    divides the CRC-32 of ``<doc_id>:<word>``.
    """
    bounded_batches(docs.sparkSession)
    given = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    counted = given.mapInArrow(_count(least_chars, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _half(rows: DataFrame, first: bool) -> DataFrame:
    """Rows that also share the first (or second) half of what is between head and tail."""
    middle = F.col("size") - F.col("head") - F.col("tail")
    behind = F.col("head") + F.expr("cast((size - head - tail) div 2 as int)")
    if first:
        return rows.withColumn("head", behind)
    # The first half would lead to these pairs as well: they count there.
    passed = F.concat("passed", F.array(F.struct(behind.alias("head"), F.col("tail"))))
    return rows.withColumn("passed", passed).withColumn("tail", F.col("tail") + middle - (behind - F.col("head")))


def _shared() -> Column:
    """What a row's group shares, as a number (groups of one number are searched together)."""
    return F.xxhash64(
        "size", "head", "tail", F.expr("left(word, head)"), F.expr("if(tail = 0, '', right(word, tail))")
    )


def _shards(words: DataFrame, path: str, crowd: int) -> DataFrame:
    """A row for every query and every word to be found, with its group."""
    none = F.expr("cast(array() as array<struct<head: int, tail: int>>)")
    size = F.explode(F.expr("array(length(word) - 1, length(word), length(word) + 1)"))
    rows = words.select("word", "n", size.alias("size"), F.lit(0).alias("head"), F.lit(0).alias("tail"), none.alias("passed"))
    rows = _half(rows, True).union(_half(rows, False))
    rows = stored(rows.withColumn("part", _shared()), f"{path}/rows-0")
    done, step = [], 0
    while True:
        # A group is halved where it is too large, as long as two characters are open.
        groups = rows.groupBy("part").agg(F.sum(F.length("word")).alias("chars"), F.min(F.expr("size - head - tail")).alias("open"))
        large = groups.where((F.col("chars") > crowd) & (F.col("open") > 1)).select("part")
        large = stored(large, f"{path}/large-{step}")
        if large.isEmpty():
            return _union([*done, rows])
        done.append(rows.join(large, "part", "left_anti").select(rows.columns))
        again = rows.join(large, "part", "left_semi").select(rows.columns).drop("part")
        again = _half(again, True).union(_half(again, False))
        step += 1
        rows = stored(again.withColumn("part", _shared()), f"{path}/rows-{step}")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


NEAR = "word string, n_near long, near string, near_n long"


def _search(table: pa.Table) -> pa.Table:
    """The near words of a shard's queries: how many, and the most frequent one."""
    given = table.to_pydict()
    known = dict(zip(given["word"], given["n"], strict=True))
    words = sorted(known)  # in the order of code points
    place = {w: i for i, w in enumerate(words)}
    counts = np.array([known[w] for w in words], np.int64)
    asked = [i for i, w in enumerate(given["word"]) if given["size"][i] == len(w)]
    empty = pa.table({"word": [], "n_near": [], "near": [], "near_n": []}, schema=_schema())
    if not asked:
        return empty
    index = fm_index.Index(words)
    query = np.array([place[given["word"][i]] for i in asked], np.int64)
    head, tail = (np.array([given[c][i] for i in asked], np.int64) for c in ("head", "tail"))
    passed = [tuple((p["head"], p["tail"]) for p in given["passed"][i]) for i in asked]
    found = []
    # Queries of one kind at a time: those that begin at the tail passed a head over first.
    back = np.array([bool(p) and p[0][1] == 0 for p in passed])
    for levels in sorted(set(map(len, passed))):
        on = np.array([len(p) == levels for p in passed])
        for way in (False, True):
            some = np.flatnonzero(on & (back == way))
            if len(some):
                found.append(_first_found(index, query[some], head[some], tail[some], way, [passed[i] for i in some]))
    pairs = np.concatenate(found)
    if not len(pairs):
        return empty
    by = np.lexsort((pairs[:, 1], -counts[pairs[:, 1]], pairs[:, 0]))
    pairs = pairs[by]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]]))
    many = np.diff(np.concatenate([first, [len(pairs)]]))
    return pa.table(
        {
            "word": [words[i] for i in pairs[first, 0]],
            "n_near": many,
            "near": [words[i] for i in pairs[first, 1]],
            "near_n": counts[pairs[first, 1]],
        },
        schema=_schema(),
    )


def _schema() -> pa.Schema:
    return pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def _first_found(index, query, head, tail, way, passed) -> np.ndarray:
    """Pairs found, without those that a half passed over leads to as well."""
    pairs, asker = index.near(query, head, tail, way)
    shared = fm_index.common_prefix(index, pairs)
    length = index.lengths[pairs[:, 1]]
    keep = np.ones(len(pairs), bool)
    for level in range(len(passed[0])):
        over = np.array([p[level] for p in passed], np.int64)[asker]
        keep &= (shared < over[:, 0]) | (length < over[:, 0] + over[:, 1])
    return pairs[keep]


def near_words(words: DataFrame, shard: int = SHARD, crowd: int = CROWD) -> DataFrame:
    """``(word, n_near, near, near_n)`` of the stored ``words(word, n)`` that have near words."""
    spark = words.sparkSession
    path = scratch(spark)
    rows = _shards(words, path, crowd)
    chars = rows.agg(F.sum(F.length("word"))).first()[0] or 0
    count = parts(spark, shard, chars)
    rows = rows.withColumn("shard", F.pmod("part", F.lit(count)))
    found = rows.groupBy("shard").applyInArrow(_search, NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return stored(near.select("word", "n_near", "best.near", (-F.col("best.less")).alias("near_n")), f"{path}/near")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``, which hold no circle, by pointer doubling."""
    path = scratch(forms.sparkSession)
    now = stored(forms.select("word", F.col("form").alias("root")), f"{path}/0")
    step = 0
    while True:
        step += 1
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(now.join(ahead, "root", "left").select("word", "root", "next"), f"{path}/{step}-joined")
        if joined.where(F.col("next").isNotNull()).isEmpty():
            return now
        now = stored(joined.select("word", F.coalesce("next", "root").alias("root")), f"{path}/{step}")


def variants(
    docs: DataFrame, least_chars: int = 5, least: int = 3, every: int | None = 97, ratio: int = 2, shard: int = SHARD, crowd: int = CROWD
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``docs(doc_id, text)``."""
    path = scratch(docs.sparkSession)
    words = stored(vocabulary(docs, least_chars, least, every), f"{path}/words")
    near = near_words(words, shard, crowd)
    is_form = F.col("near_n") >= ratio * F.col("n")
    both = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"),
        F.when(is_form, F.col("near_n")).alias("form_n"),
    )
    both = stored(both, f"{path}/forms")
    ends = roots(both.where(F.col("form").isNotNull()).select("word", "form"))
    return both.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
