"""Main-text extraction from HTML by a maximum-scoring subsequence.

A page is read as a sequence of words and tags.  Words score positive, by how
often words in such an element belong to the article on labelled pages; tags
score negative, by how often such a tag lies outside it.  One linear scan finds
the contiguous stretch with the highest sum: the content region, widened to
whole blocks.  What lies inside the region but is no running text (menus,
sidebars, notices, adverts, forms, comments, scripts: known by element, role,
or the words of ``class`` and ``id``) is left out; it scores nothing, so an
advert in the middle of an article does not end it.

The words of ``class`` and ``id`` also occur in the names of what holds the
article (``has-sidebar``, ``tag-advertising``).  So a box named like that is
kept, with the boxes around it, where its own words (those in no further such
box) are more than those of any other such box and more than twice those in
none, and no ``article`` or ``main`` element without such a name has words; or
where it is an ``article`` in no such box, has more words than any other such
article and more than the articles not named like that.  Boxes inside it are
judged by their own names.

Labelled pages are those that mark their article themselves (one ``article`` or
``main`` element); weights are fitted on a bounded sample of them and are the
prior's where there are none.  The marks themselves are not looked at when a
page is extracted, but that an ``article`` inside a box named like an
advert ends that box's exclusion, and as said above.

Everything is linear in the page: unclosed comments, tags, scripts run to the
end.  Defined results: null or empty html, or a page without content words,
gives an empty text; tags that are never closed end with their parent;
repeated rows are extracted each; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, share

#: Pages drawn to fit the weights on, about.
SAMPLE = 1000
#: How many occurrences the prior counts as, and what it says.
PRIOR, WORD_PRIOR, TAG_PRIOR = 20.0, 0.7, 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


VOID = _set("area base br col embed hr img input link meta param source track wbr")
#: Elements whose content is text up to their end tag.
RAW = _set("script style title textarea xmp iframe noembed noframes noscript")
BLOCK = _set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul"
)
#: An opening tag of these ends an open element of those.
ENDS = {n: _set("p") for n in BLOCK - {"html", "body", "head"}} | {
    "li": _set("li p"), "dt": _set("dt dd p"), "dd": _set("dt dd p"), "td": _set("td th p"), "th": _set("td th p"),
    "tr": _set("tr td th p"), "option": _set("option"),
}
#: An implied end looks no further up than these.
WALL = _set("article aside body button dialog div footer form header html main nav ol section table td th ul dl")
LEFT_OUT = _set(
    "audio button canvas dialog embed footer form head iframe input label math menu nav aside object option script "
    "search select style svg template textarea video noscript title"
)
LEFT_OUT_ROLES = _set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search")
#: Words of class or id of what is no running text.
LEFT_OUT_WORDS = _set(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter "
    "notice notices overlay pager pagination popup promo promotion promotions recommendations recommended related "
    "replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets"
)
#: Words that may stand beside those in a name without changing what it says.
BESIDE_WORDS = _set(
    "area bar block body bottom box btn button buttons card col column container content discussion entry form frame "
    "global group head header heading holder icon icons inner item items left link links list main media mobile module "
    "outer page pane panel placeholder post posts reader right row section side site slot social space stories strip "
    "text thread title top unit user view wrap wrapper"
)
#: Elements of running text: what they are called says nothing of what they hold.
TEXT = _set(
    "a abbr article b blockquote br caption cite code col dd del dfn dt em figcaption figure h1 h2 h3 h4 h5 h6 i img ins "
    "kbd li mark p pre q s samp small span strong sub summary sup tbody td tfoot th thead time tr u var"
)
#: Only outside the article: its own header holds its title.
PAGE_HEADER = _set("header")
_WHOLE = _set("html body main")


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


def _left_out(name: str, source: str, in_article: bool) -> int:
    """0: kept; 1: left out for its class or id; 2: left out for what it is."""
    if name in LEFT_OUT or (name in PAGE_HEADER and not in_article):
        return 2
    if not source or name in _WHOLE:
        return 0
    given = _attributes(source)
    if given.get("role", "").lower() in LEFT_OUT_ROLES or "hidden" in given or given.get("aria-hidden") == "true":
        return 2
    if re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        return 2
    if name in TEXT:
        return 0
    listed = LEFT_OUT_WORDS if in_article else LEFT_OUT_WORDS | PAGE_HEADER
    for given_name in f"{given.get('class', '')} {given.get('id', '')}".split():
        words = {w.lower() for w in _NAME_WORD.findall(given_name)}
        # ``comment-list`` names a list of comments, ``comment-on-law`` something else.
        if words & listed and words <= listed | BESIDE_WORDS:
            return 1
    return 0


def word_count(text: str) -> int:
    return len(text.split())


def _scan(page: str, kept: frozenset[int] = frozenset(), around: dict | None = None):
    """The page's tokens, in order: ``(kind, name, text, block, marked, box)``.

    ``box``: the innermost box that is left out for its class or id, by the
    place of its tag; 0 in none.  Boxes of ``kept`` are not left out.  What is
    left out for what it is yields nothing.  ``around`` takes, for each such
    box, the one around it and whether it is an article.
    """
    stack: list[tuple[str, int, bool, int]] = []  # name, left out (inherited), inside an article, box
    opened: Counter = Counter()
    block, at, size = 0, 0, len(page)

    def top():
        return stack[-1] if stack else ("", 0, False, 0)

    def close(count: int):
        for _ in range(count):
            opened[stack.pop()[0]] -= 1

    while at < size:
        m = _TOKEN.search(page, at)
        end = m.start() if m else size
        name, out, inside, box = top()
        if end > at and out < 2:
            yield 0, name, page[at:end], block, inside, box
        if not m:
            break
        at = m.end()
        slash, tag, source = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if opened[tag] > 0:
                up = 1
                while stack[-up][0] != tag:
                    up += 1
                out = stack[-up][1] and (stack[-up - 1][1] if len(stack) > up else 0)
                box = (stack[-up][3] and stack[-up - 1][3]) if len(stack) > up else 0
                inside = stack[-up][2]
                close(up)
        else:
            ends = ENDS.get(tag, ())
            if any(opened[e] > 0 for e in ends):
                for up in range(1, len(stack) + 1):
                    if stack[-up][0] in ends:
                        close(up)
                        break
                    if stack[-up][0] in WALL:
                        break
            _, out, inside, box = top()
            mine = _left_out(tag, source.strip(" /\t\r\n"), inside)
            if mine == 1 and end + 1 in kept:
                mine = 0
            inside = inside or (tag in ("article", "main") and mine == 0)
            if tag in ("article", "main") and mine == 0 and out == 1:
                out = box = 0
            if mine == 1 and out < 2 and tag not in VOID:
                if around is not None:
                    around[end + 1] = (box, tag == "article")
                box = end + 1
            out = max(out, mine)
            if tag in RAW and not source.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                at = stop.start() if stop else size
                after = page.find(">", at)
                at = after + 1 if stop and after >= 0 else size
            elif tag not in VOID and not source.endswith("/"):
                stack.append((tag, out, inside, box))
                opened[tag] += 1
        if tag in BLOCK:
            block += 1
        if out == 0 or (out == 1 and box):
            yield (2 if tag == "br" else 1), tag, "", block, inside, box


def _boxes_kept(tokens: list, around: dict[int, tuple[int, bool]]) -> frozenset[int]:
    """The boxes that hold the page's text for all their names, and those around them."""
    own: Counter = Counter()
    marked = 0
    for kind, _, text, _, inside, box in tokens:
        if kind == 0:
            n = word_count(text)
            own[box] += n
            marked += n if inside and not box else 0
    best = max(around, key=lambda b: own[b])
    found = {best} if not marked and own[best] > 2 * own[0] else set()
    articles = [b for b, (outer, article) in around.items() if article and not outer]
    best = max(articles, key=lambda b: own[b], default=0)
    if best and own[best] > marked:
        found.add(best)
    kept: set[int] = set()
    for b in found:
        while b:
            kept.add(b)
            b = around[b][0]
    return frozenset(kept)


def read_page(page: str):
    """The page's tokens, in order: ``(kind, name, text, block, marked)``.

    kind: 0 a word run (``name``: the element around it), 1 a tag, 2 a break
    inside a block.  What is left out yields nothing.  ``block`` numbers the
    blocks; ``marked`` says whether an article or main element is open.
    """
    around: dict[int, tuple[int, bool]] = {}
    tokens = list(_scan(page, around=around))
    kept = _boxes_kept(tokens, around) if around else None
    for token in _scan(page, kept) if kept else tokens:
        if not token[5]:
            yield token[:5]


def extract(page: str | None, words: dict[str, float], tags: dict[str, float]) -> str:
    """The main text: blocks in page order, parted by an empty line."""
    tokens = list(read_page(page or ""))
    best, run, first, last, start = 0.0, 0.0, 0, -1, 0
    for i, (kind, name, text, _, _) in enumerate(tokens):
        if kind == 0:
            run += word_count(text) * words.get(name, WORD_PRIOR)
        elif kind == 1:
            run -= tags.get(name, TAG_PRIOR)
        if run < 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, first, last = run, start, i
    if last < first:
        return ""
    low, high = tokens[first][3], tokens[last][3]
    pieces: dict[int, list[str]] = {}
    for kind, _, text, block, _ in tokens:
        if low <= block <= high and kind != 1:
            pieces.setdefault(block, []).append(html.unescape(text) if kind == 0 else " ")
    blocks = (" ".join("".join(p).split()) for p in pieces.values())
    return "\n\n".join(b for b in blocks if b)


COUNTS = "kind int, name string, inside long, outside long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by element and tags by name, inside and outside the marked article."""
    for b in batches:
        found: Counter = Counter()
        for page in b.column(0):
            tokens = list(read_page(page.as_py() or ""))
            if not any(t[1] in ("article", "main") for t in tokens if t[0] == 1):
                continue  # not labelled
            for kind, name, text, _, marked in tokens:
                if kind < 2 and not (kind == 1 and name in ("article", "main")):
                    found[kind, name, marked] += word_count(text) if kind == 0 else 1
        keys = sorted({k[:2] for k in found})
        cols = [[k[0] for k in keys], [k[1] for k in keys], [found[(*k, True)] for k in keys], [found[(*k, False)] for k in keys]]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["kind", "name", "inside", "outside"])


def fit_weights(pages: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], dict[str, float]]:
    """(word weights by element, tag costs by name) from a sample of pages."""
    # Drawn by a hash of the page's number where the page lies: nothing is
    # sorted, and only counts leave the tasks.
    rate = min(1.0, sample / max(1, pages.count()))
    drawn = pages.where(share("page_id", F.lit("drawn")) < rate).where(F.lower("html").rlike("<(article|main)[ >]"))
    counts = drawn.select(F.col("html").cast("string")).mapInArrow(_counted, COUNTS).groupBy("kind", "name")
    # At most a fifth of the names in a sample's tags; rare ones are as the prior has them.
    rows = counts.agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).where("inside + outside >= 5")
    words, tags = {}, {}
    for r in rows.collect():
        seen = r["inside"] + r["outside"]
        if r["kind"] == 0:
            words[r["name"]] = (r["inside"] + PRIOR * WORD_PRIOR) / (seen + PRIOR)
        else:
            tags[r["name"]] = (r["outside"] + PRIOR * TAG_PRIOR) / (seen + PRIOR)
    return words, tags


def main_text(pages: DataFrame, weights: tuple[dict[str, float], dict[str, float]] | None = None) -> DataFrame:
    """``(page_id, url, text)`` of every page."""
    bounded_batches(pages.sparkSession)
    words, tags = weights or fit_weights(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(p.as_py(), words, tags) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    given = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return given.mapInArrow(run, "page_id long, url string, text string")
