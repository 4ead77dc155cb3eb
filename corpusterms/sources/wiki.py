"""MediaWiki XML dumps.

``read_wiki_pages`` uses Spark's built-in XML source with ``rowTag=page``
and a fixed schema: the dump is split into pages in parallel (by file
split), header elements outside ``<page>`` are ignored, and unknown
elements are dropped by the schema.  Nothing is read into the driver.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.markup import split_front_matter, squeeze_lines, wikitext_clean
from ..operators.markdown import markdown_text
from ..schemas import REVISION, WIKI_PAGE
from ..storage import stored

CORRUPT = "_corrupt"
_REVISION_NO_TEXT = StructType([f for f in REVISION.fields if f.name != "text"])


def read_wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a dump: (title, ns, id, revision array<struct<...>>).

    A page that is not well-formed, or has a value of another type, keeps its
    source in ``_corrupt``; ``page_documents`` leaves it out (it has no key to
    be registered by), ``corrupt_pages`` returns it.

    ``revision.text`` is read as ``struct<_VALUE>`` so that an empty
    ``<text/>`` is NULL rather than ''.
    """
    pages = (
        spark.read.format("xml")
        .option("rowTag", "page")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .schema(StructType([*WIKI_PAGE.fields, StructField(CORRUPT, StringType(), True)]))
        .load(path)
    )
    # A value is only checked if its column is read: this always holds and asks
    # for every column, so that a page is corrupt for every query or for none.
    return pages.where(F.hash(*WIKI_PAGE.fieldNames()) >= F.lit(-(2**31)))


#: What a dump holds beside its pages, which the reader leaves out.
DUMP_HEADER = (
    '<mediawiki xml:lang="en"><siteinfo><sitename>Wiki</sitename>'
    '<namespaces><namespace key="0" case="first-letter" /></namespaces></siteinfo></mediawiki>'
)
# Characters that XML 1.0 can't hold.
_NOT_XML = r"[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def write_wiki_dump(pages: DataFrame, path: str) -> None:
    """Pages as a MediaWiki XML dump: a folder of files, written by all tasks.

    Every revision is marked minor by an empty element, as dumps have it, and
    the header (``siteinfo``) is a file of its own.  Characters that XML can't
    hold become U+FFFD; a null text is left out.
    """

    def held(c: Column) -> Column:
        return F.regexp_replace(c, _NOT_XML, "\ufffd")

    def marked(r: Column) -> Column:
        text = F.when(r["text"]["_VALUE"].isNotNull(), F.struct(held(r["text"]["_VALUE"]).alias("_VALUE")))
        return r.withField("text", text).withField("comment", held(r["comment"])).withField("minor", F.lit(""))

    rows = pages.select(held(F.col("title")).alias("title"), "ns", "id", F.transform("revision", marked).alias("revision"))
    dump = rows.write.mode("overwrite").format("xml")
    dump.option("rootTag", "mediawiki").option("rowTag", "page").option("declaration", "").save(path)
    pages.sparkSession.range(1).select(F.lit(DUMP_HEADER).alias("value")).write.mode("append").text(path)


def _meta(pages: DataFrame) -> Column:
    """All page fields, revision text removed."""
    return F.struct(
        "title",
        "ns",
        "id",
        F.transform("revision", lambda r: r.dropFields("text")).alias("revision"),
    )


def page_documents(pages: DataFrame, squeeze: bool = True) -> DataFrame:
    """One document per page, as the dump splitter wrote it.

    Columns: ``document`` = ``<first revision id>.wiki``, ``meta`` (struct,
    revision texts removed), ``text`` = the first revision's wikitext (blank
    lines dropped, lines trimmed when ``squeeze``), and ``rendered`` =
    ``---\\n<meta as JSON>\\n---\\n<text>`` (JSON is valid YAML front matter).
    """
    if CORRUPT in pages.columns:
        pages = pages.where(F.col(CORRUPT).isNull())
    first = F.get(F.col("revision"), 0)
    text = F.coalesce(first["text"]["_VALUE"], F.lit(""))
    if squeeze:
        text = squeeze_lines(text)
    docs = pages.select(
        F.concat(first["id"], F.lit(".wiki")).alias("document"),
        _meta(pages).alias("meta"),
        text.alias("text"),
    )
    return docs.withColumn(
        "rendered",
        F.concat(F.lit("---\n"), F.to_json("meta"), F.lit("\n---\n"), F.col("text")),
    )


def clean_documents(docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Wikitext documents to markdown documents named ``<document>.md``.

    ``docs`` has (document, meta, text).  The first revision's comment is
    cleaned the same way as the text.  Documents whose output name is in
    ``existing`` (a frame of ``document`` names) are skipped: a left anti
    join, so a rerun does only what is missing.
    """
    first = F.get(F.col("meta.revision"), 0)
    cleaned = first.withField("comment", F.col("comment"))
    out = docs.select(
        F.concat(F.col("document"), F.lit(".md")).alias("document"),
        "meta",
        wikitext_clean(first["comment"]).alias("comment"),
        wikitext_clean(F.col("text")).alias("text"),
    ).select(
        "document",
        F.col("meta")
        .withField("revision", F.when(first.isNotNull(), F.array(cleaned)).otherwise(F.col("meta.revision")))
        .alias("meta"),
        "text",
    )
    if existing is not None:
        out = out.join(existing.select("document"), "document", "left_anti")
    return out


def page_corpus(pages: DataFrame) -> DataFrame:
    """Pages to a corpus ``(document, text)`` of plain text.

    Wikitext becomes markdown, which is stored, and the markdown's text is the
    corpus: heading and list marks are no tokens and break no n-gram.
    """
    return markdown_text(stored(clean_documents(page_documents(pages)).select("document", "text")))


def wiki_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Dump to a corpus ``(document, text)`` of plain text; corrupt pages are left out.

    Count or keep those with ``corrupt_pages(read_wiki_pages(...))``.
    """
    return page_corpus(read_wiki_pages(spark, path))


def corrupt_pages(pages: DataFrame) -> DataFrame:
    """The pages that do not fit the schema: ``(title, id, raw)``, raw their source.

    ``title`` and ``id`` are what could be read of them, if anything.
    """
    return pages.where(F.col(CORRUPT).isNotNull()).select("title", "id", F.col(CORRUPT).alias("raw"))


def _yaml_value(front: Column, key: str, indent: str) -> Column:
    """A scalar of block-style YAML, unquoted; NULL where it is absent or null."""
    raw = F.regexp_extract(front, rf"(?m)^{indent}{key}: (.*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(raw, r"^'(.*)'$", "$1"), r'^"(.*)"$', "$1")
    bare = F.replace(bare, F.lit("''"), F.lit("'"))
    return F.when((raw != "") & ~raw.isin("null", "~"), bare)


def _yaml_meta(front: Column) -> Column:
    """Page fields and the first revision's from YAML, as the splitter writes it."""
    first = F.regexp_extract(front, r"(?s)\nrevision:\n(- .*?)(?:\n- |\z)", 1)
    revision = F.struct(
        *[
            F.struct(
                _yaml_value(first, "username", "    ").alias("username"), _yaml_value(first, "id", "    ").alias("id")
            ).alias(f.name)
            if f.name == "contributor"
            else _yaml_value(first, f.name, "(?:- |  )").alias(f.name)
            for f in _REVISION_NO_TEXT.fields
        ]
    )
    return F.struct(
        _yaml_value(front, "title", "").alias("title"),
        _yaml_value(front, "ns", "").try_cast("long").alias("ns"),
        _yaml_value(front, "id", "").try_cast("long").alias("id"),
        F.when(first != "", F.array(revision)).alias("revision"),
    )


def read_wiki_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of ``.wiki`` files (front matter + wikitext) as documents.

    Columns: document (file name), meta (the page struct: from JSON front
    matter, as ``page_documents`` renders it, or from block-style YAML, where
    the page's fields and its first revision are read), front_matter (the raw
    block; NULL without one), text (the wikitext body).
    """
    raw = spark.read.text(path, wholetext=True)
    meta_schema = StructType(
        [f for f in WIKI_PAGE.fields if f.name != "revision"]
        + [StructField("revision", ArrayType(_REVISION_NO_TEXT), True)]
    )
    fm = split_front_matter(F.col("value"))
    docs = raw.select(F.col("_metadata.file_name").alias("document"), fm.alias("fm"))
    front = F.col("fm.meta")
    meta = F.when(F.ltrim(front).startswith("{"), F.from_json(front, meta_schema)).when(
        front.isNotNull(), _yaml_meta(front).cast(meta_schema)
    )
    return docs.select("document", meta.alias("meta"), front.alias("front_matter"), F.col("fm.body").alias("text"))


def clean_wiki_files(spark: SparkSession, path: str, done_path: str | None = None) -> DataFrame:
    """``.wiki`` files to cleaned ``<name>.md`` documents, skipping done ones.

    ``done_path`` is a Parquet table of earlier outputs (column
    ``document``); outputs already there are left out (left anti join).
    """
    existing = None
    if done_path is not None:
        try:
            existing = spark.read.parquet(done_path).select("document")
        except AnalysisException as e:  # no outputs yet
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return clean_documents(read_wiki_files(spark, path), existing)
