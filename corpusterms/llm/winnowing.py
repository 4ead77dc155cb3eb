"""Document fingerprints by winnowing (native).

A text is read in lower case as units: pieces of words of up to six characters
that end behind a cut letter (the rest of a word is a unit, too), and single
characters in scripts without spaces.  Units are parted by what stands there,
not by counting from a start, so shared text has the same units wherever it
begins, from its first cut letter or word on; only a run without white space
and cut letters is read in blocks from its start.  Every ``k`` units in a row
have a hash; of every ``w`` hashes in a row the least is taken, the rightmost
of equals.  The fingerprint is the chosen (position, hash) pairs.
Guarantee: whatever shares ``w + k - 1`` units in a row shares a fingerprint
hash, and nothing shorter than ``k`` units ever matches.

Everything is a column expression.  A position's hash and its place are
packed into one long (hash above, place counted backwards below), so that the
plain minimum of a window is its least hash at its rightmost place.

Defined results: a null text counts as empty; a text without units has the
empty fingerprint; fewer than ``k`` units are one k-gram, fewer than ``w``
k-grams one window; two empty fingerprints are alike (1.0), an empty one and
another are not (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scripts that are written without spaces: Thai, Lao; Tibetan; Myanmar; Khmer;
#: kana; Han.
SPACELESS = (
    r"\u0E00-\u0EFF\u0F00-\u0FFF\u1000-\u109F\u1780-\u17FF"
    r"\u3041-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
)
#: Letters and digits that end a unit, a few of each script (about one in ten).
CUTS = "ts37" "\u0442\u0441" "\u03c4\u03c3" "\u05ea\u05e9" "\u062a\u0644" "\u0924\u0938"
_INNER = rf"[^\x20\x09-\x0D{CUTS}{SPACELESS}]"
UNIT = rf"{_INNER}{{1,5}}+[{CUTS}]?|[{CUTS}{SPACELESS}]"
K, W = 4, 8
#: The place takes the lower bits, the hash the ones above (63 in all).
PLACE = 2**31
#: Ranges that rows are dealt into at most: the bounds of all go to every task.
RANGES = 1 << 16


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """The fingerprint as an array of packed (hash, place), by place."""
    found = F.transform(units(F.lower(text)), lambda u: F.xxhash64(u))

    def packed(h: Column, i: Column) -> Column:
        return F.shiftrightunsigned(h, 32) * PLACE + (PLACE - 1 - i)

    def grams(u: Column) -> Column:
        last = F.size(u) - k
        many = F.transform(
            F.sequence(F.lit(0), last), lambda i: packed(F.xxhash64(*[F.get(u, i + j) for j in range(k)]), i)
        )
        one = F.array(packed(F.xxhash64(u), F.lit(0)))
        return F.when(F.size(u) == 0, F.array().cast("array<bigint>")).when(last < 0, one).otherwise(many)

    def minima(g: Column) -> Column:
        last = F.size(g) - w
        many = F.transform(F.sequence(F.lit(0), last), lambda i: F.least(*[F.get(g, i + j) for j in range(w)]))
        return F.when(F.size(g) == 0, g).when(last < 0, F.array(F.array_min(g))).otherwise(F.array_distinct(many))

    return _let(_let(found, grams), minima)


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 31)))


def spelled(fingerprint: Column) -> Column:
    """``place:hash`` in hexadecimal, in order of place, parted by spaces."""

    def word(x: Column) -> Column:
        place = F.lit(PLACE - 1) - x.bitwiseAND(F.lit(PLACE - 1))
        return F.concat(F.hex(place), F.lit(":"), F.hex(F.shiftright(x, 31)))

    return F.array_join(F.transform(fingerprint, word), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints."""

    def of(pair: Column) -> Column:
        both = F.size(F.array_intersect(pair["a"], pair["b"]))
        either = F.size(pair["a"]) + F.size(pair["b"]) - both
        return F.when(either == 0, F.lit(1.0)).otherwise(both / either)

    return _let(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), of)


def _numbers(values) -> Column:
    """An array of longs from one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_next(docs: DataFrame, rows_per_range: int = 2000) -> DataFrame:
    """``docs`` with ``next_row``: the row that follows by descending ``doc_id``.

    After the last row comes the first again; rows of one ``doc_id`` are
    ordered by a hash of their text, a null ``doc_id`` comes last.  Rows are
    dealt into ranges of (``doc_id``, hash) that measured quantiles bound, so
    neither ids far apart nor one id in very many rows make a large range.  The
    window of a range sees, besides its own rows, the first row of the range
    that follows: every row moves once.  Rows alike in both are one text, so
    where they would fill ranges they are spread, each followed by its like.
    """
    order = [F.col("doc_id").isNull().cast("long"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)), F.xxhash64("text")]
    names = ["null_id", "falling", "hash"]
    keys = docs.select(*[c.cast("long").alias(n) for c, n in zip(order, names, strict=True)])
    total = docs.count()
    count = max(1, min(RANGES, total // rows_per_range))
    least = keys.repartitionByRange(count, *names).groupBy(F.spark_partition_id().alias("range"))
    bounds = sorted(tuple(r.key) for r in least.agg(F.min(F.struct(*names)).alias("key")).collect())
    if not bounds:
        bounds = [(0, 0, 0)]
    crowd = 4 * max(rows_per_range, total // RANGES)
    heavy = keys.groupBy(*names).count().where(F.col("count") > crowd).collect()  # less than RANGES of them

    arrays = [_numbers(b[i] for b in bounds) for i in range(3)]
    key = F.struct(*[c.cast("long") for c in order])

    def bound(i: Column) -> Column:
        return F.struct(*[F.get(a, i) for a in arrays])

    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    found = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda i, step: F.when((i + step < len(bounds)) & (bound(i + step) <= key), i + step).otherwise(i),
    )
    spread = F.lit(0)
    for r in heavy:
        like = key == F.struct(*[F.lit(r[n]).cast("long") for n in names])
        spread = F.when(like, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-r["count"] // crowd))).cast("int")).otherwise(spread)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    dealt = docs.select(row.alias("row"), key.alias("key"), found.alias("range"), spread.alias("spread"))
    own = F.struct("range", F.lit(0).alias("handed"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(len(bounds))).alias("range"), F.lit(1).alias("handed"))
    first = (F.col("key") == bound(F.col("range"))) & (F.col("spread") == 0)
    places = F.when(first, F.array(own, before)).otherwise(F.array(own))
    dealt = dealt.select("row", "key", "spread", F.inline(places))
    ordered = Window.partitionBy("range", "spread").orderBy("handed", "key")
    dealt = dealt.withColumn("next_row", F.lead("row").over(ordered)).where("handed = 0")
    return dealt.select("row.*", F.coalesce("next_row", "row").alias("next_row"))


def with_edits(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, mark, edited, next_mark)``: marks are fingerprints.

    ``edited`` is the text with its last half replaced by the first half of
    the next row's.  Each text's fingerprint is made once and goes along.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    both = with_next(rows.withColumn("mark", winnow(F.col("text"))))
    half = F.expr("cast(length(text) div 2 as int)")
    kept = F.expr("left(text, length(text) - cast(length(text) div 2 as int))")
    edited = F.concat(kept, F.left(F.col("next_row.text"), half))
    return both.select("doc_id", "text", "mark", edited.alias("edited"), F.col("next_row.mark").alias("next_mark"))
