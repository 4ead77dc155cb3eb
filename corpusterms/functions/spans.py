"""Small scans that regular expressions can't do in linear time.

Nested marks (templates in templates) and tags without an end: each helper
reads a text once.  They run in Arrow batches behind ``pandas_udf`` and
travel to the executors by value.
"""

from __future__ import annotations

import html
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import bounded_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def drop_balanced(text: str, opens: str, closes: str, only: re.Pattern | None = None) -> str:
    """``text`` with every matched ``opens ... closes`` replaced by a space.

    Pairs nest to any depth; marks without a partner stay.  ``only``: drop a
    pair only where what follows its opening mark matches (and with it all
    that is inside).
    """
    if opens not in text or closes not in text:
        return text
    stack: list[int] = []
    spans: list[tuple[int, int]] = []
    mark = re.compile(f"{re.escape(opens)}|{re.escape(closes)}")
    for m in mark.finditer(text):
        if m[0] == opens:
            stack.append(m.start())
        elif stack:
            begin = stack.pop()
            if only is None or only.match(text, begin + len(opens)):
                while spans and spans[-1][0] > begin:
                    spans.pop()  # inside this one
                spans.append((begin, m.end()))
    out, at = [], 0
    for begin, end in spans:
        out += [text[at:begin], " "]
        at = end
    return "".join([*out, text[at:]])


def drop_tagged(text: str, opens: re.Pattern, closes: re.Pattern) -> str:
    """``text`` with every stretch from ``opens`` to the next ``closes`` replaced by a space."""
    out, at = [], 0
    while m := opens.search(text, at):
        end = closes.search(text, m.end())
        if not end:  # none further on either
            break
        out += [text[at : m.start()], " "]
        at = end.end()
    return "".join([*out, text[at:]])


_COMMENT = re.compile("<!--"), re.compile("-->")
_TAGGED = [
    (re.compile(rf"<{t}(?=[\s>])[^<>]*(?<!/)>", re.I), re.compile(rf"</{t}\s*>", re.I)) for t in ("ref", "gallery", "math")
]


def wiki_spans(text: str, namespaces: list[str]) -> str:
    """Wikitext without comments, references, templates, tables and media links."""
    text = drop_tagged(text, *_COMMENT)
    text = re.sub(r"<ref(?=[\s/])[^<>]*/>", " ", text, flags=re.I)
    for opens, closes in _TAGGED:
        text = drop_tagged(text, opens, closes)
    text = drop_balanced(text, "{{", "}}")
    text = drop_balanced(text, "{|", "|}")
    media = re.compile(r"\s*(?:" + "|".join(map(re.escape, namespaces)) + r")\s*:", re.I)
    return drop_balanced(text, "[[", "]]", media)


def without_wiki_spans(c: Column, namespaces: list[str]) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: wiki_spans(t, namespaces))

    bounded_batches()
    return F.pandas_udf(run, "string")(c)


def unescaped(c: Column) -> Column:
    """Character references (named, decimal, hexadecimal) as characters."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape)

    bounded_batches()
    return F.when(c.contains("&"), F.pandas_udf(run, "string")(c)).otherwise(c)
