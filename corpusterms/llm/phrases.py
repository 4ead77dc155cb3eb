"""Phrase collocations, counted in counting quotient filters.

Words are parts of a piece between spaces and tabs, pieces parts of a text
between ``.,;:!?`` and line ends; only A-Z are lower-cased.  Everything is
counted per language (null: ``und``).

1. *Words.*  Tasks count words; the sums per (language, word) are stored.  A
   word's id is the upper bits of a 64-bit hash of language and word, of a
   width at which no frequent word shares its id with any other (this is
   tested, not assumed; else the width grows, and at last the salt changes).
2. *Pairs*, then 3. *triples*, of adjacent words.  Tasks pack word ids, permute
   them invertibly and fill counting quotient filters, one for each leading
   part of the permuted key; filters of the same part merge like sorted lists
   (``quotient_filter``).  As a phrase is never more frequent than what it
   holds, a pair needs two frequent words and a triple two frequent pairs; a
   bit set of bounded size tells tasks which are surely not.  A set bit proves
   nothing: it only costs an entry more, and the final counts are exact.
4. *Scores.*  Joins of the frequent phrases only.

Defined results: a null or empty text has no words; repeated rows count each;
an empty table gives no rows; further columns are ignored.  Phrases of equal
score and count are ranked by their UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import quotient_filter as qf
from .common import bounded_batches, parts, scratch, stored

_BREAKS = re.compile(rb"[.,;:!?\n-\r]+")
_SPACE = re.compile(rb"[ \t\n-\r]")
#: Bytes of a text that are split at once; words gathered before they are counted.
SLICE, GATHERED = 1 << 20, 4_000_000
#: A task's own numbers for words take so many bits (three fit into 63).
LOCAL = 21
#: Words that are looked up at once.
CHUNK = 1 << 19
#: Bits of a bit set: eight for each member, as a power of two within these.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Entries of a filter bucket, at most, on average.
BUCKET = 2_000_000
#: Parts in which a language's candidates are ranked before their best are.
SALTS = 256


def _slices(text: bytes) -> Iterator[bytes]:
    """``text`` cut before white space, ``SLICE`` bytes or more each but the last."""
    at = 0
    while len(text) - at > SLICE:
        cut = _SPACE.search(text, at + SLICE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def word_id(lang: bytes, word: bytes, salt: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b"%d:%s%s" % (len(lang), lang, word), salt)


class Bits:
    """A bit set of hashes: a clear bit proves that none was put in."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.mask = raw, np.uint64(8 * len(raw) - 1)

    def has(self, x: np.ndarray) -> np.ndarray:
        place = x & self.mask
        return self.raw[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0


def bit_set(places: DataFrame, members: int) -> Bits:
    """The bit set of ``places(hash long)``, built in Spark from 4 KB pieces."""
    size = LEAST_BITS
    while size < min(MOST_BITS, 8 * members):
        size *= 2
    place = F.col("hash").bitwiseAND(F.lit(size - 1)) + 1
    pieces = places.groupBy(F.bitmap_bucket_number(place).alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    raw = np.zeros(size // 8, np.uint8)
    for piece, bits in pieces.collect():  # at most MOST_BITS in all, whatever the corpus
        raw[(piece - 1) * 4096 : piece * 4096] = np.frombuffer(bits, np.uint8)
    return Bits(raw)


def _pair_hash(a, b):
    """Of two word ids; the same in numpy (unsigned, modulo 2^64) and as columns."""
    return a ^ (b << np.uint64(17)) ^ (b >> np.uint64(11)) ^ (a << np.uint64(41))


def _pair_hash_column(a: Column, b: Column) -> Column:
    shifted = F.shiftleft(b, 17).bitwiseXOR(F.shiftrightunsigned(b, 11)).bitwiseXOR(F.shiftleft(a, 41))
    return a.bitwiseXOR(shifted)


class _Numbers(dict):
    """A language's words as the task's own numbers; 0 parts phrases."""

    def __init__(self, lang: bytes, shard: _Shard):
        super().__init__({b".": 0})
        self.lang, self.shard = lang, shard

    def __missing__(self, word: bytes) -> int:
        number = self[word] = self.shard.number(self.lang, word)
        return number


class _Shard:
    """The words of a task's texts, as numbers, until they are counted."""

    def __init__(self, n: int, salt: int, width: int, frequent: Bits | None = None):
        self.n, self.salt, self.width, self.frequent = n, salt, width, frequent
        self.buffer: list[np.ndarray] = []
        self.held = 0
        self._forget()

    def _forget(self) -> None:
        self.langs: dict[bytes, _Numbers] = {}
        self.ids, self.names, self.spent = [0], [(b"", b"")], 0

    def number(self, lang: bytes, word: bytes) -> int:
        self.spent += 1
        known = word_id(lang, word, self.salt)
        if self.frequent is not None:
            known >>= 64 - self.width
            place = known & int(self.frequent.mask)
            if not self.frequent.raw[place >> 3] >> (place & 7) & 1:
                return 0
        self.ids.append(known)
        if self.n == 1:
            self.names.append((lang, word))
        return len(self.ids) - 1

    def add(self, lang: bytes, text: bytes):
        """Take a text in; yields (numbers, ids, names) whenever enough is gathered."""
        tail: list[bytes] = []
        for part in _slices(text.lower()):
            words = _BREAKS.sub(b" . ", part).split()
            for at in range(0, len(words), CHUNK):
                some = words[at : at + CHUNK]
                if self.spent + len(some) >= 1 << LOCAL or self.held >= GATHERED:
                    yield self.gathered()
                    self._forget()
                    some = tail + some  # for the phrases that began before
                numbers = self.langs.get(lang)
                if numbers is None:
                    numbers = self.langs[lang] = _Numbers(lang, self)
                self.buffer.append(np.fromiter(map(numbers.__getitem__, some), np.int64, len(some)))
                self.held += len(some)
                tail = (tail + some[-2:])[1 - self.n :] if self.n > 1 else []
        self.buffer.append(np.zeros(1, np.int64))

    def gathered(self):
        numbers = np.concatenate([*self.buffer, np.zeros(1, np.int64)])
        self.buffer, self.held = [], 0
        return numbers, np.array(self.ids, np.uint64), self.names


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            if text.is_valid:
                yield lang.as_py().encode(), text.as_buffer().to_pybytes()


def _all_gathered(batches, shard: _Shard):
    for lang, text in _texts(batches):
        yield from shard.add(lang, text)
    if shard.held:
        yield shard.gathered()


def _count_words(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, ids, names in _all_gathered(batches, _Shard(1, salt, 64)):
            counts = np.bincount(numbers, minlength=len(ids))
            seen = np.flatnonzero(counts[1:]) + 1
            for lo in range(0, len(seen), 65_536):
                some = seen[lo : lo + 65_536]
                cols = [
                    pa.array([names[i][0].decode() for i in some], pa.string()),
                    pa.array([names[i][1].decode() for i in some], pa.string()),
                    pa.array(ids[some].view(np.int64), pa.int64()),
                    pa.array(counts[some], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "word", "hash", "n"])

    return run


def _phrases(numbers: np.ndarray, ids: np.ndarray, n: int, pairs: Bits | None):
    """Distinct n-grams of ids and their counts."""
    ok = (numbers[:-1] > 0) & (numbers[1:] > 0)
    if n == 3:
        if pairs is not None:
            at = np.flatnonzero(ok)
            ok[at] = pairs.has(_pair_hash(ids[numbers[at]], ids[numbers[at + 1]]))
        ok = ok[:-1] & ok[1:]
    at = np.flatnonzero(ok)
    packed = np.zeros(len(at), np.int64)
    for i in range(n):
        packed = packed << LOCAL | numbers[at + i]
    found, counts = np.unique(packed, return_counts=True)
    mask = (1 << LOCAL) - 1
    return [ids[found >> LOCAL * (n - 1 - i) & mask] for i in range(n)], counts.astype(np.int64)


def _fill(n: int, salt: int, width: int, shared: int, frequent, pairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = None if pairs is None else Bits(pairs.value)
        for numbers, ids, _ in _all_gathered(batches, _Shard(n, salt, width, Bits(frequent.value))):
            if len(numbers) < n:
                continue
            keys, counts = _phrases(numbers, ids, n, wide)
            keys, counts = qf.merged(qf.permuted(keys, width), counts)
            rows, size = [], 0
            for row in qf.split(keys, counts, width, shared):
                rows.append(row)
                size += len(row[1])
                if size > 4 << 20:
                    yield _filters(rows)
                    rows, size = [], 0
            if rows:
                yield _filters(rows)

    return run


def _filters(rows) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    kinds = (pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "filter"])


def _merge(n: int, width: int, shared: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        loaded = [qf.load(f.as_py(), n, width, shared) for f in table.column("filter")]
        keys = [np.concatenate([k[i] for k, _ in loaded]) for i in range(n)]
        keys, counts = qf.merged(keys, np.concatenate([c for _, c in loaded]))
        often = counts >= least
        keys = qf.restored([k[often] for k in keys], width)
        cols = [pa.array(k.view(np.int64), pa.int64()) for k in keys]
        return pa.table([*cols, pa.array(counts[often], pa.int64())], names=[*(f"id{i + 1}" for i in range(n)), "a"])

    return run


class _Corpus:
    """The counts of a corpus, each level stored in the shared folder."""

    def __init__(self, docs: DataFrame, least: int):
        self.spark: SparkSession = docs.sparkSession
        bounded_batches(self.spark)
        self.docs = docs.select(
            F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")
        )
        self.least, self.path = least, scratch(self.spark)

    def words(self) -> DataFrame:
        """``(lang, word, hash, n)`` of every word; sets ``width`` and ``salt``."""
        for self.salt in range(8):
            counted = self.docs.mapInArrow(_count_words(self.salt), "lang string, word string, hash long, n long")
            words = counted.groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))
            words = stored(words, f"{self.path}/words-{self.salt}")
            often = F.col("n") >= self.least
            many = words.agg(F.count(F.lit(1)), F.count(F.when(often, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
            self.frequent, self.total = many[1], many[2]
            least_width = (int(many[0]) + 1).bit_length() + (int(many[1]) + 1).bit_length() + 3
            for self.width in [*range(max(40, least_width), 64, 4), 64]:
                ids = words.select(F.shiftrightunsigned("hash", 64 - self.width).alias("id"), "n")
                shared = ids.groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n"))
                if shared.where((F.col("words") > 1) & often).isEmpty():
                    return words
        raise RuntimeError("frequent words shared their 64-bit ids under eight salts")

    def phrases(self, n: int, frequent, pairs=None) -> DataFrame:
        """``(id1 .. idn, a)`` of the phrases that occur often enough."""
        buckets = 1
        while buckets < parts(self.spark, BUCKET, self.total):
            buckets *= 2
        shared = buckets.bit_length() - 1
        fill = _fill(n, self.salt, self.width, shared, frequent, pairs)
        filters = self.docs.mapInArrow(fill, "bucket long, filter binary")
        kind = ", ".join([*(f"id{i + 1} long" for i in range(n)), "a long"])
        found = filters.groupBy("bucket").applyInArrow(_merge(n, self.width, shared, self.least), kind)
        return stored(found, f"{self.path}/phrases-{n}")


def _score(a: str, left: str, right: str) -> Column:
    """Exact up to counts of 10^16."""
    whole = "cast({} as decimal(38,0))".format
    return F.expr(f"({whole(a)} * {a} * 1000000) div ({whole(left)} * {right})")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, cover: int = 50) -> DataFrame:
    """Each language's ``top`` phrases of 2 to 3 words: ``(lang, rank, phrase, a, l, r, n, score)``.

    ``a``: occurrences, ``least`` or more; ``l`` and ``r``: those of the two
    parts at the lowest-scoring cut; ``n``: all words of the language.  A
    phrase inside a longer candidate goes where that one has ``cover`` per cent
    of its occurrences or more.
    """
    corpus = _Corpus(docs, least)
    spark, path = corpus.spark, corpus.path
    words = corpus.words()
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.where(F.col("n") >= least).select(
        "lang", "word", F.shiftrightunsigned("hash", 64 - corpus.width).alias("id"), F.col("n").alias("f")
    )
    often = stored(often, f"{path}/frequent")
    bits = bit_set(often.select(F.col("id").alias("hash")), corpus.frequent)
    frequent = spark.sparkContext.broadcast(bits.raw)  # at most MOST_BITS
    pairs = corpus.phrases(2, frequent)
    hashes = pairs.select(_pair_hash_column(F.col("id1"), F.col("id2")).alias("hash"))
    triples = corpus.phrases(3, frequent, spark.sparkContext.broadcast(bit_set(hashes, pairs.count()).raw))

    def named(i: int) -> DataFrame:
        lang = ["lang"] if i == 1 else []
        return often.select(*lang, F.col("id").alias(f"id{i}"), F.col("word").alias(f"word{i}"), F.col("f").alias(f"f{i}"))

    two = stored(pairs.join(named(1), "id1").join(named(2), "id2"), f"{path}/pairs")
    front = two.select("id1", "id2", F.col("a").alias("front"), "lang", "word1", "word2", "f1")
    back = two.select(
        F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("a").alias("back"), F.col("word2").alias("word3"), F.col("f2").alias("f3")
    )
    three = stored(triples.join(front, ["id1", "id2"]).join(back, ["id2", "id3"]), f"{path}/triples")

    held = three.select("id1", "id2", "a").union(three.select("id2", "id3", "a"))
    held = held.groupBy("id1", "id2").agg(F.max("a").alias("longer"))
    open_ = two.join(held, ["id1", "id2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    short = open_.select(
        "lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score")
    )
    long = three.select("*", _score("a", "f1", "back").alias("s1"), _score("a", "front", "f3").alias("s2"))
    first = F.col("s1") <= F.col("s2")
    long = long.select(
        "lang",
        F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"),
        "a",
        F.when(first, F.col("f1")).otherwise(F.col("front")).alias("l"),
        F.when(first, F.col("back")).otherwise(F.col("f3")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    # The best of each part of a language's phrases, then the best of those.
    ranking = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = stored(short.union(long), f"{path}/candidates").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*ranking)))
    best = best.where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*ranking)).cast("long"))
    best = best.where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
