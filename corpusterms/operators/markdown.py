"""Markdown documents to text, as a Spark job over lines.

Documents are parted into chunks at cuts (``functions.blocks``).  The chunks
of long documents are dealt over tasks and read apart: each gives what it
makes of any state that the text before it may leave open, a small value;
these are put together along a document, which tells every chunk the state it
begins in.  Link definitions reach the blocks that may name them by a join on
(document, label).  Only the inline scan of a block's source is Python, and
only blocks with inline marks come to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks, commonmark
from ..storage import stored

#: Characters of a chunk, at least; a document of no more is one chunk.
CHUNK = 65_536


def _pieces(lines: Column, carried: Column | None = None) -> Column:
    """The definitions and block sources of lines, in order, with the labels defined."""
    parts = F.transform(blocks.sources(blocks.read(lines, carried)), blocks.definitions)
    return blocks.let(
        parts,
        lambda p: F.struct(
            F.flatten(F.transform(p, lambda x: x["labels"])).alias("labels"),
            F.filter(
                F.flatten(F.transform(p, lambda x: F.concat(x["texts"], F.array(x["rest"])))), lambda x: F.trim(x) != ""
            ).alias("pieces"),
        ),
    )


#: White space but for a single space, which is what it becomes (no ``\\s``: classes of single characters are quickest).
_SPACES = r"[\t\n\x0b\f\r\x85\xa0\x{2028}\x{2029}][ \t\n\x0b\f\r\x85\xa0\x{2028}\x{2029}]*| [ \t\n\x0b\f\r\x85\xa0\x{2028}\x{2029}]+"


def _assembled(pieces: Column, marked: Column, read: Column) -> Column:
    """A line a piece: the texts ``read`` for those ``marked``, the others as they are."""

    def one(acc: Column, piece: Column) -> Column:
        plain = ~piece.eqNullSafe(F.get(marked, acc["at"]))  # a plain piece equals no marked one
        text = F.when(plain, piece).otherwise(F.get(read, acc["at"]))
        return F.struct(F.when(plain, acc["at"]).otherwise(acc["at"] + 1).alias("at"), F.concat(acc["out"], F.array(text)).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    found = F.when(F.size(read) == 0, pieces).otherwise(F.aggregate(pieces, none, one)["out"])
    squeezed = F.transform(found, lambda x: F.trim(F.regexp_replace(x, _SPACES, " ")))
    return F.array_join(F.filter(squeezed, lambda x: x != ""), "\n")


def _texts(read: DataFrame, labels: Column, *keep: str) -> DataFrame:
    """Rows of ``read(pieces, ...)`` with their text."""
    named = read.select(*keep, "pieces", labels.alias("labels"), commonmark.marked(F.col("pieces")).alias("marked"))
    scanned = named.withColumn("read", commonmark.texts(F.col("marked"), F.col("labels")))
    return scanned.select(*keep, _assembled(F.col("pieces"), F.col("marked"), F.col("read")).alias("text"))


def _own(labels: Column, names: Column) -> Column:
    """Of ``names``, those defined by ``labels``."""
    defined = F.array_intersect(F.transform(names, blocks.normal), labels)
    return F.when(F.size(labels) == 0, F.array().cast("array<string>")).otherwise(
        F.filter(names, lambda n: F.array_contains(defined, blocks.normal(n)))
    )


def _short(corpus: DataFrame, chunk: int) -> DataFrame:
    """Documents of one chunk: read where they are."""
    own = corpus.where(F.length(F.coalesce("text", F.lit(""))) <= chunk)
    found = _pieces(blocks.lines(blocks.body(F.col("text"))))
    read = own.select("document", F.inline(F.array(found)))  # a generator's rows are computed once
    return _texts(read, _own(F.col("labels"), blocks.named(F.col("pieces"))), "document")


def _long(corpus: DataFrame, chunk: int) -> DataFrame:
    """``(document, row, chunk, text)`` of documents of more characters than a chunk."""
    own = corpus.where(F.length("text") > chunk)
    parts = blocks.chunks(blocks.body(F.col("text")), chunk)
    parted = own.select("document", F.monotonically_increasing_id().alias("row"), parts.alias("chunks"))
    last = F.size("chunks") - 1
    each = parted.select("document", "row", last.alias("last"), F.posexplode("chunks").alias("chunk", "source"))
    ended = F.when(F.col("chunk") < F.col("last"), F.expr("left(source, length(source) - 1)")).otherwise(F.col("source"))
    # So many tasks in any case: reading a chunk costs more than its bytes tell.
    tasks = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    each = stored(each.select("document", "row", "chunk", ended.alias("source")).repartition(tasks, "row", "chunk"))
    if each.isEmpty():
        return each.select("document", "row", "chunk", F.col("source").alias("text"))
    effects = each.select("row", "chunk", blocks.effect(blocks.lines(F.col("source"))).alias("effect"))
    # A document's effects one after another: the state before each chunk.
    clean = blocks.clean()
    along = F.aggregate(
        F.array_sort(F.collect_list(F.struct("chunk", "effect"))),
        F.struct(clean.alias("now"), F.array().cast("array<struct<chunk:int,fence:string,length:int,raw:int>>").alias("before")),
        lambda acc, x: F.struct(
            blocks.follow(x["effect"], acc["now"]).alias("now"),
            F.concat(
                acc["before"],
                F.array(F.struct(x["chunk"].alias("chunk"), *[acc["now"][n].alias(n) for n in ("fence", "length", "raw")])),
            ).alias("before"),
        ),
    )
    begun = effects.groupBy("row").agg(along["before"].alias("before")).select("row", F.inline("before"))
    carried = F.struct("fence", "length", "raw")
    read = each.join(stored(begun), ["row", "chunk"])
    found = _pieces(blocks.lines(F.col("source")), carried)
    read = stored(read.select("document", "row", "chunk", F.inline(F.array(found))))
    defined = read.select("row", F.explode("labels").alias("label")).distinct()
    names = read.select("row", "chunk", F.explode(blocks.named(F.col("pieces"))).alias("name"))
    names = names.withColumn("label", blocks.normal(F.col("name"))).join(defined, ["row", "label"], "left_semi")
    names = stored(names.groupBy("row", "chunk").agg(F.collect_list("name").alias("names")))
    both = read.join(names, ["row", "chunk"], "left")
    none = F.array().cast("array<string>")
    both = both.select("document", "row", "chunk", "pieces", F.coalesce("names", none).alias("names"))
    return _texts(both, F.col("names"), "document", "row", "chunk")


def markdown_chunks(corpus: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(document, row, chunk, text)`` of a corpus of markdown: a chunk's text, a line a block.

    The chunks of a row of the corpus, in order, hold its text; a short
    document is chunk 0 (and its ``row`` null).  A null text has no lines;
    front matter is left out.  The corpus is read twice, the second time for
    its long documents: store it first if it is dear to compute.
    """
    corpus = corpus.select("document", "text")
    short = _short(corpus, chunk).select("document", F.lit(None).cast("long").alias("row"), F.lit(0).alias("chunk"), "text")
    return short.unionByName(_long(corpus, chunk))


def markdown_text(corpus: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(document, text)`` of a corpus of markdown, a line a block.

    Short documents stay where they are; only the chunks of long ones move.
    """
    corpus = corpus.select("document", "text")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"])
    joined = F.array_join(F.filter(parts, lambda x: x != ""), "\n")
    whole = _long(corpus, chunk).groupBy("document", "row").agg(joined.alias("text")).select("document", "text")
    return _short(corpus, chunk).unionByName(whole)
