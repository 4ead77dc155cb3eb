"""Tokens, terms and n-grams of texts too long for one task.

The per-document operators (``tokens``, ``terms``, ``ngrams``) keep a document
in its row: memory is bounded by the largest one.  Here a text is cut into
pieces, which are rows of their own, dealt over tasks, and what crosses a cut
is stitched; the results equal those of the uncut text.

* Cuts are behind white space or a character that is always a token by itself
  (outside letters, digits, white space and punctuation).  No token reaches
  across, but for a wiki-table run (``{|`` and all known characters after it).
* Whether a run is open where a piece begins: a piece with such a lone
  character, or with a ``{|``, decides it for its end, any other hands on what
  it found.  So it is the last decision before a piece, a window over the
  (few) pieces of a text.  What an open run swallows at the start of a piece
  belongs to the run's token.
* Counts of pieces are summed per document; positions start where the tokens
  of the pieces before end; a piece's n-grams see the first words of the next.
* Pieces are dealt by groups of ``GROUP`` neighbours, so that they are stitched
  where they lie.  Only texts of more groups need what other groups tell: a row
  a group, and for the tables of counts a sum over the groups.  So what is
  shuffled is text, not tokens, but for the counts of such texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import with_value_counts
from ..functions.tokens import ALNUM, PUNCT_CLASS, TABLE_OPEN, WHITE_SPACE_CLASS, token_array, token_kind, word_lane
from ..storage import stored
from .ngrams import _lowers, _ngram_array
from .terms import doc_terms_from_words

#: Characters of a piece, at least.
PIECE = 1 << 20
#: Pieces of a text, one after another, that are dealt to one task.
GROUP = 16
_KNOWN = ALNUM + r" \t\r\n" + PUNCT_CLASS
_RUN = rf"^[{_KNOWN}]*"


def _order():
    return Window.partitionBy("row").orderBy("piece")


def _in_group():
    return Window.partitionBy("row", "group").orderBy("piece")


def _over_groups():
    return Window.partitionBy("row").orderBy("group")


def _cuts(text: Column, least: int) -> Column:
    cut = rf"(?s).{{{least},}}?(?:(?<=[ \t\r\n])|(?<=[^{_KNOWN}])|\z)|.+"
    return F.when(F.length(text) <= least, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(cut), F.lit(0)))


def text_pieces(corpus: DataFrame, least: int = PIECE) -> DataFrame:
    """``(document, row, piece, group, many, text, swallowed, owner)``: the stored pieces of a corpus.

    ``row`` numbers the rows of the corpus (names may come again), ``piece``
    the pieces of one, ``group`` their groups; ``many``: the text has more than
    one.  ``text`` is what begins tokens in the piece; ``swallowed`` what goes
    before, to the wiki-table run that began in piece ``owner`` (null: none is
    open).  A null or empty text is one empty piece.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = corpus.select("document", F.monotonically_increasing_id().alias("row"), _cuts(text, least).alias("pieces"))
    many = F.size("pieces") > GROUP
    cut = rows.select("document", "row", many.alias("many"), F.posexplode("pieces").alias("piece", "text"))
    # A run is open at the end if a ``{|`` comes behind the last lone character.
    alone = F.col("text").rlike(f"[^{_KNOWN}]")
    tail = F.regexp_extract("text", rf"(?<![{_KNOWN}])[{_KNOWN}]*+\z", 0)
    ends_open = F.contains("text", F.lit(TABLE_OPEN)) & F.contains(tail, F.lit(TABLE_OPEN))
    group = F.expr(f"piece div {GROUP}").cast("int")
    tasks = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cut = cut.repartition(tasks, "row", "piece")
    cut = stored(cut.select("*", group.alias("group"), alone.alias("alone"), ends_open.alias("ends_open")))
    opens = F.when(F.col("ends_open"), True).when(F.col("alone"), False)
    every = cut.select("row", "piece", opens.alias("opens"), "alone")
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("entered", F.coalesce(F.last("opens", ignorenulls=True).over(before), F.lit(False)))
    # A ``{|`` within an open run begins none.
    begins = F.when(F.col("opens") & (F.col("alone") | ~F.col("entered")), F.col("piece"))
    every = every.withColumn("owner", F.last(begins, ignorenulls=True).over(before)).where("entered").select("row", "piece", "owner")
    # Stored: the join sees how few there are, and the texts stay where they lie.
    both = cut.join(stored(every), ["row", "piece"], "left")
    swallowed = F.when(F.col("owner").isNotNull(), F.regexp_extract("text", _RUN, 0)).otherwise("")
    both = both.withColumn("swallowed", swallowed)
    rest = F.expr("substr(text, length(swallowed) + 1)")
    return both.select("document", "row", "piece", "group", "many", rest.alias("text"), "swallowed", "owner")


def _dealt(pieces: DataFrame) -> DataFrame:
    """The pieces, those of a group in one task."""
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return pieces.repartition(tasks, "row", "group")


def tokens(corpus: DataFrame, least: int = PIECE) -> DataFrame:
    """``operators.tokens.tokens`` of texts of any length."""
    pieces = text_pieces(corpus, least)
    parts = pieces.where(F.col("owner").isNotNull()).groupBy("row", F.col("owner").alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "swallowed"))), lambda x: x["swallowed"]), "")
    more = stored(parts.agg(joined.alias("more")))
    # Where the groups of a text begin.
    counted = pieces.where("many").groupBy("row", "group").agg(F.sum(F.size(token_array(F.col("text")))).alias("size"))
    before = _over_groups().rowsBetween(Window.unboundedPreceding, -1)
    base = stored(counted.select("row", "group", F.sum("size").over(before).alias("base")).where("group > 0"))
    listed = _dealt(pieces.select("document", "row", "group", "piece", "text").join(more, ["row", "piece"], "left"))
    listed = listed.select("document", "row", "group", "piece", "more", token_array(F.col("text")).alias("tokens"))
    listed = listed.withColumn("size", F.size("tokens"))
    inside = F.sum("size").over(_in_group().rowsBetween(Window.unboundedPreceding, -1))
    listed = listed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(base, ["row", "group"], "left")
    first = F.col("inside") + F.coalesce("base", F.lit(0))
    each = listed.select("document", first.alias("first"), "more", (F.col("size") - 1).alias("last"), F.posexplode_outer("tokens").alias("at", "token"))
    each = each.where(F.col("token").isNotNull())
    whole = F.when(F.col("more").isNotNull() & (F.col("at") == F.col("last")), F.concat("token", "more")).otherwise(F.col("token"))
    kind = token_kind(F.col("token"))
    return each.select("document", (F.col("first") + F.col("at")).alias("pos"), whole.alias("token"), kind.alias("kind"))


def _words(pieces: DataFrame) -> DataFrame:
    """``(document, words)`` of each group; its document is named ``(document, row)``."""
    lanes = _dealt(pieces).select("document", "row", "group", F.array_remove(word_lane(F.col("text")), "").alias("words"))
    grouped = lanes.groupBy("document", "row", "group").agg(F.flatten(F.collect_list("words")).alias("words"))
    return grouped.select(F.struct("document", "row").alias("document"), "words")


def term_info(corpus: DataFrame, least: int = PIECE) -> DataFrame:
    """``operators.terms.term_info`` of texts of any length.

    Terms are counted within the groups, then, for texts of more than one,
    summed per document (rows of one name apart): an exchange of their groups'
    distinct terms.
    """
    pieces = text_pieces(corpus, least)
    frequency = (F.col("occurence") / F.col("term_count").cast("double")).alias("frequency")

    def rows(some: DataFrame) -> DataFrame:
        # The outer generators: see terms.term_stats.
        return doc_terms_from_words(_words(some)).select("document", "term_count", F.inline_outer("terms")).where(F.col("term").isNotNull())

    one = rows(pieces.where("not many")).select("document.document", "term", "lower", "occurence", frequency)
    counted = stored(rows(pieces.where("many")).groupBy("document", "term", "lower").agg(F.sum("occurence").alias("occurence")))
    totals = counted.groupBy("document").agg(F.count(F.lit(1)).alias("term_count"))
    return one.unionByName(counted.join(totals, "document").select("document.document", "term", "lower", "occurence", frequency))


def doc_info(corpus: DataFrame, least: int = PIECE) -> DataFrame:
    """``operators.terms.doc_info`` of texts of any length."""
    pieces = text_pieces(corpus, least)
    one = _words(pieces.where("not many")).select("document.document", F.size(F.array_distinct("words")).cast("long").alias("term_count"))
    words = _words(pieces.where("many")).select("document", F.explode_outer(F.array_distinct("words")).alias("term"))
    terms = words.groupBy("document", "term").agg(F.lit(1).alias("one"))
    counts = terms.groupBy("document").agg(F.count("term").alias("term_count"))
    return one.unionByName(counts.select("document.document", "term_count"))


def _ngrams(corpus: DataFrame, n: int, least: int) -> DataFrame:
    """``(document, row, group, many, grams)`` by piece, with those that reach into the next."""
    # Every piece here has a token, so the next n - 1 tokens are in the next n - 1 pieces.
    pieces = text_pieces(corpus, least).where(F.col("text").rlike(f"[^{WHITE_SPACE_CLASS}]"))
    lane, none = word_lane(F.col("text")), F.array().cast("array<string>")

    def ahead(window) -> list[Column]:
        return [F.coalesce(F.lead("head", k).over(window), none) for k in range(1, n)]

    def heads(of: Column) -> Column:
        return F.slice(of, 1, n - 1).alias("head")

    # What a group of a longer text needs of the next ones: so many tokens at most.
    begun = pieces.where("many").select("row", "group", "piece", heads(lane))
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "head"))), lambda x: x["head"]))
    begun = begun.groupBy("row", "group").agg(heads(listed))
    behind = stored(begun.select("row", "group", F.slice(F.concat(*ahead(_over_groups())), 1, n - 1).alias("behind")))
    lanes = _dealt(pieces).select("document", "row", "group", "piece", "many", lane.alias("lane"))
    lanes = lanes.select("*", heads(F.col("lane")))
    lanes = lanes.select("document", "row", "group", "many", "lane", F.concat(*ahead(_in_group())).alias("ahead"))
    lanes = lanes.join(behind, ["row", "group"], "left")
    after = F.slice(F.concat("ahead", F.coalesce("behind", none)), 1, n - 1)
    both = lanes.select("document", "row", "group", "many", F.concat("lane", after).alias("lane"))
    return both.select("document", "row", "group", "many", _ngram_array(F.col("lane"), n).alias("grams"))


def ngram_rows(corpus: DataFrame, n: int = 2, least: int = PIECE) -> DataFrame:
    """``operators.ngrams.ngram_rows`` of texts of any length."""
    g = _ngrams(corpus, n, least).select("document", F.explode_outer("grams").alias("term")).where(F.col("term").isNotNull())
    return g.select("document", "term", *_lowers(F.col("term"), n), F.lit(1).cast("long").alias("occurence"))


def ngram_counts(corpus: DataFrame, n: int = 2, least: int = PIECE) -> DataFrame:
    """``operators.ngrams.ngram_counts`` of texts of any length.

    Counted within the groups; those of longer texts are summed.
    """
    grams = _ngrams(corpus, n, least)

    def rows(some: DataFrame) -> DataFrame:
        grouped = some.groupBy("document", "row", "group").agg(F.flatten(F.collect_list("grams")).alias("grams"))
        counted = with_value_counts(grouped, "grams", "vc", ["document", "row"])
        found = counted.select("document", "row", F.inline_outer("vc")).where(F.col("value").isNotNull())
        return found.select("document", "row", F.col("value").alias("term"), F.col("count").cast("long").alias("occurence"))

    summed = rows(grams.where("many")).groupBy("document", "row", "term").agg(F.sum("occurence").alias("occurence"))
    both = rows(grams.where("not many")).unionByName(summed)
    return both.select("document", "term", *_lowers(F.col("term"), n), "occurence")
