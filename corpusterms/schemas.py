"""Fixed schemas (never inferred)."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

S, L, D, B = StringType(), LongType(), DoubleType(), BooleanType()


def _s(*fields: tuple[str, object, bool]) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


CONTRIBUTOR = _s(("username", S, True), ("id", S, True))
REVISION = _s(
    ("id", S, True),
    ("parentid", S, True),
    ("timestamp", S, True),
    ("contributor", CONTRIBUTOR, True),
    ("comment", S, True),
    ("model", S, True),
    ("format", S, True),
    ("text", _s(("_VALUE", S, True)), True),
    ("sha1", S, True),
)
WIKI_PAGE = _s(("title", S, True), ("ns", L, True), ("id", L, True), ("revision", ArrayType(REVISION), True))

# Derived tables.  ``term_info`` is stored enriched: the reference columns
# first, then per-document context that the scoring operators read.
TERM_INFO = _s(
    ("document", S, False),
    ("term", S, False),
    ("lower", S, False),
    ("occurence", L, False),
    ("frequency", D, True),
)
TERM_STATS = StructType(
    TERM_INFO.fields
    + [
        StructField("term_count", L, False),
        StructField("token_total", L, False),
        StructField("lower_first", B, False),
        StructField("doc_first", B, False),
    ]
)
TERM_DOC_INFO = _s(("term", S, False), ("doc_count", L, False))
DOC_INFO = _s(("document", S, False), ("term_count", L, False))
NGRAM_TWO = _s(("document", S, False), ("term", S, False), ("lower1", S, False), ("lower2", S, False), ("occurence", L, False))
NGRAM_THREE = _s(
    ("document", S, False),
    ("term", S, False),
    ("lower1", S, False),
    ("lower2", S, False),
    ("lower3", S, False),
    ("occurence", L, False),
)
TOKEN = _s(("pos", L, False), ("token", S, False), ("kind", S, False))
