"""The inline scan of one CommonMark block.

What a reader of the running text sees is kept: text, link text, titles of
images; code spans, raw HTML and images' alt texts go.  Where a construct is
taken out, a space stays, so that markup never joins two words.

A block's characters are read once; emphasis is matched by delimiter runs with
a linked list, and no search for an opener passes a place twice for its kind.
The block structure is found by column expressions (``functions.blocks``).
"""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_left

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Functions of this module travel to the executors by value: nothing has to be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TAG = r"(?:<[A-Za-z][A-Za-z0-9-]*+(?:\s[^<>]*+)?>|</[A-Za-z][A-Za-z0-9-]*+\s*+>|<[A-Za-z][A-Za-z0-9-]*+/>)"
_TARGET = re.compile(
    r"\([ \n]*(?:<[^<>\n]*>|[^\s()<][^\s()]*(?:\([^\s()]*\)[^\s()]*)*|)"
    r"(?:[ \n]+(?:\"([^\"]*)\"|'([^']*)'|\(([^()]*)\)))?[ \n]*\)"
)
_INLINE = re.compile(
    r"\\(?:[!-/:-@\[-`{-~]|\n)|`+|!?\[|\]|[*_]+"
    r"|<[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*>|<[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9.-]+>"
    r"|" + _TAG + r"|<!--|<\?[^>]*\?>|<![A-Za-z][^>]*>"
    r"|&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});",
    re.A,
)


class _Runs:
    """Delimiter runs of a block, in a list linked both ways."""

    def __init__(self):
        self.spot, self.mark, self.count, self.opens, self.closes, self.whole = [], [], [], [], [], []
        self.prev, self.next, self.tail = [], [], -1

    def add(self, spot: int, mark: str, count: int, opens: bool, closes: bool) -> None:
        i = len(self.spot)
        for where, what in zip(
            (self.spot, self.mark, self.count, self.opens, self.closes, self.whole, self.prev, self.next),
            (spot, mark, count, opens, closes, count, self.tail, -1),
            strict=True,
        ):
            where.append(what)
        if self.tail >= 0:
            self.next[self.tail] = i
        self.tail = i

    def drop(self, i: int) -> None:
        p, n = self.prev[i], self.next[i]
        if p >= 0:
            self.next[p] = n
        if n >= 0:
            self.prev[n] = p
        if i == self.tail:
            self.tail = p

    def match(self, nodes: list[str], since: int) -> None:
        """Pair the runs from node ``since`` on; used marks become spaces."""
        i = self.tail
        first = -1
        while i >= 0 and self.spot[i] >= since:
            first, i = i, self.prev[i]
        bottom: dict[tuple, int] = {}
        below, i = i, first
        while i >= 0:
            after = self.next[i]
            while self.closes[i] and self.count[i]:
                kind = (self.mark[i], self.opens[i], self.whole[i] % 3)
                stop = bottom.get(kind, below)
                j = self.prev[i]
                while j > max(stop, below):  # places in the list rise; ``stop`` may have left it
                    odd = (self.closes[j] or self.opens[i]) and (self.whole[j] + self.whole[i]) % 3 == 0
                    odd = odd and (self.whole[j] % 3 or self.whole[i] % 3)
                    if self.opens[j] and self.mark[j] == self.mark[i] and self.count[j] and not odd:
                        break
                    j = self.prev[j]
                else:
                    bottom[kind] = self.prev[i]
                    break
                use = 2 if self.count[j] >= 2 and self.count[i] >= 2 else 1
                while self.prev[i] != j:  # runs between a pair stay as they are
                    self.drop(self.prev[i])
                for k, before in ((j, False), (i, True)):
                    self.count[k] -= use
                    left = self.mark[k] * self.count[k]
                    nodes[self.spot[k]] = f" {left} " if left else " "
                if not self.count[j]:
                    self.drop(j)
            if not self.count[i] or not self.opens[i]:
                self.drop(i)
            i = after
        while self.tail >= 0 and self.spot[self.tail] >= since:
            self.drop(self.tail)


def _punctuation(c: str) -> bool:
    return not c.isalnum() and not c.isspace()


def inline_text(source: str, labels: set[str]) -> str:
    """The text of a block's inline content; ``labels``: the names in it that are defined."""
    nodes: list[str] = []
    runs = _Runs()
    brackets: list[tuple[int, bool, int]] = []  # node, image?, place behind it
    ticks: dict[int, list[int]] = {}
    for m in re.finditer(r"`+", source):
        ticks.setdefault(len(m[0]), []).append(m.start())
    last_comment = source.rfind("-->")
    at, size = 0, len(source)
    while at < size:
        m = _INLINE.search(source, at)
        if not m:
            nodes.append(source[at:])
            break
        if m.start() > at:
            nodes.append(source[at : m.start()])
        at, got = m.end(), m[0]
        c = got[0]
        if c == "\\":
            nodes.append(" " if got[1] == "\n" else got[1])
        elif c == "`":
            same = ticks.get(len(got), [])
            after = bisect_left(same, at)
            if after < len(same):
                nodes.append(" ")
                at = same[after] + len(got)
            else:
                nodes.append(got)
        elif c in "*_":
            before = source[m.start() - 1] if m.start() else " "
            after = source[at] if at < size else " "
            left = not after.isspace() and (not _punctuation(after) or before.isspace() or _punctuation(before))
            right = not before.isspace() and (not _punctuation(before) or after.isspace() or _punctuation(after))
            # A match of both marks is cut into runs of one.
            for run in re.findall(r"\*+|_+", got):
                opens = left if run[0] == "*" else left and (not right or _punctuation(before))
                closes = right if run[0] == "*" else right and (not left or _punctuation(after))
                if opens or closes:
                    runs.add(len(nodes), run[0], len(run), opens, closes)
                nodes.append(run)
        elif got in ("[", "!["):
            brackets.append((len(nodes), got != "[", at))
            nodes.append(got)
        elif c == "]":
            if not brackets:
                nodes.append(got)
                continue
            node, image, begin = brackets.pop()
            target = _TARGET.match(source, at) if source.startswith("(", at) else None
            title = (target[1] or target[2] or target[3] or "") if target else ""
            end = target.end() if target else None
            if not target and labels:
                close = source.find("]", at + 1, at + 1001) if source.startswith("[", at) else -1
                name = source[at + 1 : close] if close > at + 1 else source[begin : m.start()]
                if name in labels:
                    end = close + 1 if close > at else at
            if end is None:
                nodes.append(got)
                continue
            runs.match(nodes, node)
            at = end
            if image:
                del nodes[node:]
                nodes.append(f" {html.unescape(title)} ")
            else:
                nodes[node] = " "
                nodes.append(" ")
        elif c == "&":
            nodes.append(html.unescape(got))
        elif got == "<!--":
            if last_comment >= at:
                at = source.find("-->", at) + 3
                nodes.append(" ")
            else:
                nodes.append(got)
        elif c == "<" and (re.match(r"<[A-Za-z][A-Za-z0-9+.-]{1,31}:", got) or ("@" in got and " " not in got and "=" not in got)):
            nodes.append(f" {got[1:-1]} ")
        else:
            nodes.append(" ")
    runs.match(nodes, 0)
    return "".join(nodes)


#: Without any of these a source is its own text.
PLAIN = r"^[^\x00\\`*_\[\]<&]*$"
#: Begins a definition's text, in which only character references are read.
DEFINED = "\x00"


def texts(sources: Column, labels: Column) -> Column:
    """The texts of blocks, given their sources and the names in them that are defined."""

    def one(source: str, names: set[str]) -> str:
        return html.unescape(source[1:]) if source.startswith(DEFINED) else inline_text(source, names)

    def run(sources: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([[one(s, set(n)) for s in some] for some, n in zip(sources, labels, strict=True)], dtype=object)

    read = F.pandas_udf(run, "array<string>")(sources, labels)
    return F.when(F.size(sources) == 0, F.array().cast("array<string>")).otherwise(read)


def marked(sources: Column) -> Column:
    """The sources that are not their own text, in order."""
    return F.filter(sources, lambda s: ~s.rlike(PLAIN))
