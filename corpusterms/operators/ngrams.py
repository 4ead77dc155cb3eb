"""Bigrams and trigrams of adjacent word tokens.

Windows run over *all* kept tokens: punctuation or an omitted character
between two words breaks the n-gram, white space does not.  The word lane
(``functions.tokens.word_lane``) holds '' in the slot of every non-word
token, so an n-gram is a window of the lane with no '' inside.

Both forms are built inside the document's row: ``ngram_rows`` (the bag, one
row per occurrence) is a narrow explode; ``ngram_counts`` counts within the
row by sort + run length, so neither form shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import with_value_counts
from ..functions.tokens import KIND_TEXT, word_lane


def _ngram_array(lane: Column, n: int) -> Column:
    """array<string> of the space-joined n-grams of a word lane, in order."""
    if n not in (2, 3):
        raise ValueError("n must be 2 or 3")
    size = F.size(lane)
    length = F.greatest(size - (n - 1), F.lit(0))
    names = ["a", "b", "c"][:n]
    shifted = [F.slice(lane, i + 1, length).alias(names[i]) for i in range(n)]

    def gram(e):
        ok = e["a"] != ""
        for nm in names[1:]:
            ok = ok & (e[nm] != "")
        return F.when(ok, F.concat_ws(" ", *[e[nm] for nm in names]))

    return F.array_compact(F.transform(F.arrays_zip(*shifted), gram))


def _lowers(term: Column, n: int) -> list[Column]:
    parts = F.split(F.lower(term), " ")
    return [F.get(parts, i).alias(f"lower{i + 1}") for i in range(n)]


def ngram_arrays(corpus: DataFrame, n: int) -> DataFrame:
    """(document, grams) with the n-grams of each document in text order.

    Takes a corpus (document, text) or lanes (document, lane).
    """
    if "lane" not in corpus.columns:
        corpus = corpus.select("document", word_lane(F.col("text")).alias("lane"))
    return corpus.select("document", _ngram_array(F.col("lane"), n).alias("grams"))


def ngram_rows(corpus: DataFrame, n: int = 2) -> DataFrame:
    """One row per n-gram occurrence, ``occurence`` = 1 (as built).

    Columns: document, term (original case, space-joined), lower1..lowerN,
    occurence.
    """
    if n not in (2, 3):
        raise ValueError("n must be 2 or 3")
    if "lane" not in corpus.columns:
        corpus = corpus.select("document", word_lane(F.col("text")).alias("lane"))
    # A row per slot that reads its members at its place in the lane and in the
    # lower-cased lane (as many slots: words hold no spaces): plain expressions,
    # compiled, where a lambda would be interpreted slot by slot.
    lowers = F.split(F.lower(F.array_join("lane", " ")), " ")
    # _outer + filter: see terms.term_stats (no inferred pre-filter).
    g = corpus.select("document", "lane", lowers.alias("lowers"))
    g = g.select("document", "lane", "lowers", F.posexplode_outer("lane").alias("at", "first"))
    members = [F.col("first"), *[F.get("lane", F.col("at") + i) for i in range(1, n)]]
    whole = F.lit(True)
    for m in members:
        whole = whole & (m != "")
    return g.where(whole).select(
        "document",
        F.concat_ws(" ", *members).alias("term"),
        *[F.get("lowers", F.col("at") + i).alias(f"lower{i + 1}") for i in range(n)],
        F.lit(1).cast("long").alias("occurence"),
    )


def ngram_counts(corpus: DataFrame, n: int = 2) -> DataFrame:
    """N-gram occurrences counted per (document, term): the grouped form."""
    counted = with_value_counts(ngram_arrays(corpus, n), "grams", "vc", ["document"])
    g = counted.select("document", F.inline_outer("vc")).where(F.col("value").isNotNull())
    return g.select(
        "document",
        F.col("value").alias("term"),
        *_lowers(F.col("value"), n),
        F.col("count").cast("long").alias("occurence"),
    )


def count_rows(bag: DataFrame) -> DataFrame:
    """Group an n-gram bag (e.g. a stored ``ngram_two``) into counts.

    One ``groupBy`` with partial aggregation; rows of one document written
    by one task collapse before the exchange.  The lower-cased members are made
    from the term behind the exchange; only a row with other ones ships them.
    """
    keys = [c for c in bag.columns if c == "document" or c == "term" or c.startswith("lower")]
    lowers = [c for c in keys if c.startswith("lower")]
    n = len(lowers)
    if "term" not in keys or set(lowers) != {f"lower{i + 1}" for i in range(n)} or not n:
        return bag.groupBy(*keys).agg(F.sum("occurence").cast("long").alias("occurence"))
    # (Made from a term again, so that no list of parts is kept for every row.)
    same = F.lower("term").eqNullSafe(F.concat_ws(" ", *[f"lower{i + 1}" for i in range(n)]))
    for c in lowers:
        same = same & F.col(c).isNotNull() & ~F.contains(c, F.lit(" "))
    others = F.when(same, None).otherwise(F.struct(*lowers))
    counted = bag.select("document", "term", others.alias("others"), "occurence")
    counted = counted.groupBy("document", "term", "others").agg(F.sum("occurence").cast("long").alias("occurence"))
    made = dict(zip([f"lower{i + 1}" for i in range(n)], _lowers(F.col("term"), n), strict=True))
    columns = [F.when(F.col("others").isNull(), made[c]).otherwise(F.col(f"others.{c}")).alias(c) if c in made else F.col(c) for c in keys]
    return counted.select(*columns, "occurence")


def ngram_rows_from_tokens(tokens_df: DataFrame, n: int = 2, block: int = 100_000) -> DataFrame:
    """The n-gram bag from a token table (document, pos, token, kind).

    For token tables already stored (``operators.tokens.tokens``): members
    stand at positions one after another, all word tokens.  ``lead`` runs over
    a window per (document, ``block`` positions); a block is handed the first
    ``n - 1`` tokens of the next, so no window holds a whole document and a
    long one is dealt over tasks.  Only word tokens are shuffled: what stands
    between them shows as a gap in the positions.  From raw text ``ngram_rows``
    is cheaper, as it needs no shuffle.
    """
    if n not in (2, 3):
        raise ValueError("n must be 2 or 3")
    block = max(int(block), n - 1)  # a halo reaches one block
    own = F.expr(f"pos div {block}")
    # The first tokens of a block also go to the block before.
    halo = (F.col("pos") % block < n - 1) & (own > 0)
    places = F.when(halo, F.array(own, own - 1)).otherwise(F.array(own))
    # (The outer generator: see terms.term_stats.)
    words = tokens_df.where(F.col("kind") == KIND_TEXT).select("document", "pos", "token", F.explode_outer(places).alias("block"))
    w = Window.partitionBy("document", "block").orderBy("pos")
    ahead = [F.lead(F.struct("token", "pos"), k).over(w).alias(f"t{k}") for k in range(1, n)]
    t = words.select("document", "pos", "block", "token", *ahead)
    ok = own == F.col("block")
    for k in range(1, n):
        ok = ok & (F.col(f"t{k}.pos") == F.col("pos") + k)
    members = [F.col("token")] + [F.col(f"t{k}.token") for k in range(1, n)]
    g = t.where(ok).select("document", F.concat_ws(" ", *members).alias("term"))
    return g.select("document", "term", *_lowers(F.col("term"), n), F.lit(1).cast("long").alias("occurence"))
