"""Markup to text.

Markdown is an operator of its own (``operators.markdown``).  HTML and wikitext
are ordered ``regexp_replace`` chains in the JVM; what nests or
may lack an end (templates, tables, media links, references) is taken out by
linear scans first (``functions.spans``), so that a chain holds only patterns
that look at a line or a tag at a time.

Rules for those patterns: no repeated group (Java's engine recurses once per
turn, and a long line would exhaust the stack), and nothing that runs on past
the next opener of its kind (an unclosed opener repeated through a document
would cost the square of its length).  Java patterns get the UNIX_LINES flag
so that only ``\n`` ends a line; replacements write groups as ``{1}``.

A removed inline construct leaves one space, so markup boundaries stay word
boundaries.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import unescaped, without_wiki_spans

Step = tuple[str, str]

# --- front matter ---------------------------------------------------------------
FRONT_MATTER_RE = r"\A(?:---|\+\+\+)[ \t]*\n(?:(?s:.*?)\n)?(?:---|\+\+\+)[ \t]*(?:\n|\z)"
_FRONT_MATTER_PARTS_RE = r"\A(?:---|\+\+\+)[ \t]*\n(?:((?s:.*?))\n)?(?:---|\+\+\+)[ \t]*(?:\n|\z)((?s:.*))"

# --- HTML pages --------------------------------------------------------------
HTML_STEPS: list[Step] = [
    # what is never closed runs to the end
    (r"(?s)<!--.*?(?:-->|\z)", " "),
    (r"(?is)<script\b[^<>]*>.*?(?:</script[^<>]*>|\z)", " "),
    (r"(?is)<style\b[^<>]*>.*?(?:</style[^<>]*>|\z)", " "),
    (r"(?i)<!DOCTYPE[^<>]*>", " "),
    (r"</?[A-Za-z][^<>]*>", " "),
]

# --- MediaWiki wikitext -------------------------------------------------------
# Namespaces of embedded media and category links (fixed values; English
# names and the Malay ones of the reference's target wiki):
MEDIA_NAMESPACES = ["File", "Image", "Category", "Fail", "Imej", "Kategori"]


WIKITEXT_STEPS: list[Step] = [
    # behaviour switches such as __NOTOC__
    (r"__[A-Z]+__", " "),
    # interlanguage links ([[en:Page]])
    (r"\[\[[a-z]{2,3}(?:-[a-z]{2,8})?:[^\[\]]*\]\]", " "),
    (r"\[\[[^\[\]|]*\|([^\[\]|]*)\]\]", "{1}"),
    (r"\[\[([^\[\]|]*)\]\]", "{1}"),
    (r"\[(?:https?:)?//[^ \t\r\n\[\]]+[ \t]+([^\[\]]*)\]", "{1}"),
    (r"\[(?:https?:)?//[^ \t\r\n\[\]]+\]", " "),
    (r"'{2,5}", ""),
    # list markers before headings: ``##`` is not a list
    (r"(?m)^[*#:;]+[ \t]*", "- "),
    (r"</?[A-Za-z][^<>]*>", " "),
    (r"[ \t]{2,}", " "),
    (r"(?m) $", ""),
] + [
    # runs of blanks are single by now, so a heading is read once
    (r"(?m)^={%d} ?([^=\n](?:[^\n]*[^=\n])??) ?={%d}$" % (n, n), "#" * n + " {1}")
    for n in (6, 5, 4, 3, 2)
]

# Trim each line and drop empty lines (the dump splitter did this).
# White space is Unicode's, as in the splitter; a run is entered at its start only.
_BLANK = r"[\p{IsWhite_Space}&&[^\n]]"
SQUEEZE_LINES_STEPS: list[Step] = [
    (r"\r\n?", "\n"),
    (r"(?m)^" + _BLANK + r"+", ""),
    (r"(?m)(?<!" + _BLANK + ")" + _BLANK + r"+$", ""),
    (r"\n{2,}", "\n"),
    (r"\A\n|\n\z", ""),
]


# --- rendering ----------------------------------------------------------------

_GROUP = re.compile(r"\{(\d)\}")


def java_replacement(r: str) -> str:
    r = r.replace("\\", "\\\\").replace("$", "\\$")
    return _GROUP.sub(lambda m: "$" + m.group(1), r)


def java_pattern(p: str) -> str:
    return "(?d)" + p


def apply_steps(c: Column, steps: list[Step]) -> Column:
    for p, r in steps:
        c = F.regexp_replace(c, F.lit(java_pattern(p)), F.lit(java_replacement(r)))
    return c


# --- public column functions --------------------------------------------------


def html_text(html: Column) -> Column:
    """HTML to text: comments, scripts, styles and tags removed, references decoded."""
    return unescaped(apply_steps(F.coalesce(html, F.lit("")), HTML_STEPS))


def wikitext_clean(wikitext: Column, namespaces: list[str] | None = None) -> Column:
    """Wikitext to light markdown: inline markup gone, headings/lists kept."""
    lines = F.regexp_replace(F.coalesce(wikitext, F.lit("")), "\r\n?", "\n")
    plain = without_wiki_spans(lines, namespaces or MEDIA_NAMESPACES)
    return apply_steps(plain, WIKITEXT_STEPS)


def squeeze_lines(text: Column) -> Column:
    return apply_steps(text, SQUEEZE_LINES_STEPS)


def split_front_matter(doc: Column) -> Column:
    """struct(meta, body): the front matter block (or NULL) and the rest."""
    has = doc.rlike(java_pattern(FRONT_MATTER_RE))
    meta = F.regexp_extract(doc, java_pattern(_FRONT_MATTER_PARTS_RE), 1)
    body = F.regexp_replace(doc, java_pattern(FRONT_MATTER_RE), "")
    return F.struct(F.when(has, meta).alias("meta"), body.alias("body"))
