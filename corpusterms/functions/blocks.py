"""CommonMark's block structure as column expressions.

A text is an array of lines; the block state (open quotes and list items, a
fence, a raw HTML block, a paragraph) is a struct; a line is a function from
state to state, ``step``, and a text is the fold of its lines.  All of it is
``aggregate`` over arrays in the JVM.

At a *cut* (a heading or list mark at the start of a line, or an unindented
line after a blank one) every container and paragraph ends, so all that a
state can carry across is an open fence or raw HTML block: ``carried``.  What a
chunk of lines between two cuts makes of any such state is a finite value,
``effect``: a fence or raw block that ends nowhere in the chunk is handed on
as it is, one that ends leaves the rest of the chunk to be read from its end.
Effects are applied one after another (``follow``), so chunks are read apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (CommonMark) -----------------------------------------------
# Tags that open a raw HTML block which a blank line ends.
HTML_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link "
    "main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead "
    "title tr track ul"
).split()
# Opening and end of the other raw HTML blocks.
HTML_BLOCKS = [
    (r"<(?:script|pre|style|textarea)(?:[ \t>]|$)", r"</(?:script|pre|style|textarea)>"),
    (r"<!--", r"-->"),
    (r"<\?", r"\?>"),
    (r"<![A-Za-z]", r">"),
    (r"<!\[CDATA\[", r"\]\]>"),
]
# -----------------------------------------------------------------------------
#: Containers open at once; the marks of more are text.
MOST_NESTED = 100
#: Lines that a state holds one by one.
HELD = 100
#: Number of the raw HTML block that a blank line ends.
BLANK_ENDED = len(HTML_BLOCKS)

_QUOTE = r"^ {0,3}>[ \t]?"
_ITEM = r"^ {0,3}(?:[-*+]|([0-9]{1,9})[.)])(?=[ ]|$)"
_FENCE = r"^ {0,3}(?:(`{3,})[^`]*$|(~{3,}).*$)"
_HEADING = r"^ {0,3}#{1,6}(?: |$)"
_RULE = r"^ {0,3}(?=[*_-])(?:[* ]++|[- ]++|[_ ]++)$"
_UNDERLINE = r"^ {0,3}(?:=+|-+) *$"
_FLOW = r"(?i)^ {0,3}</?(?:" + "|".join(HTML_BLOCK_TAGS) + r")(?:[ \t>]|/>|$)"
_ALONE = (
    r"^ {0,3}(?:<[A-Za-z][A-Za-z0-9-]*+(?:\s[^<>]*+)?>|</[A-Za-z][A-Za-z0-9-]*+\s*+>|<[A-Za-z][A-Za-z0-9-]*+/>) *$"
)
_DEFINITION = (
    r"\G {0,3}\[(?=\s*[^\[\]\s])([^\[\]]*+)\]:[ \n]*(?:<[^<>\n]*>|[^\s<]\S*)"
    r"(?:[ \n]+(?:\"([^\"]*)\"|'([^']*)'|\(([^()]*)\)))?[ ]*(?:\n|\z)"
)
#: A line that needs none of the rules where no container, fence or raw block is open.
_ORDINARY = r"^[^ \t>*+\-0-9#`~<=_]"
#: Front matter: between two equal lines of --- or +++ at the start.
_FRONT = r"\A(---|\+\+\+)[ \t]*\n(?:(?s:.*?)\n)?\1[ \t]*(?:\n|\z)"
#: Parts blocks; CommonMark allows no NUL in a text.
_MARK = "\x00"
#: A cut, as a place behind a line end.
CUT = r"(?:(?<=\n)(?=#{1,6} |[-*+] [^ \n])|(?<=\n\n)(?=[^ \t\n>]))"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _struct(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _from(text: Column, at: Column) -> Column:
    """``text`` without its first ``at`` characters."""
    return F.substr(text, at + 1)


def _matched(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(text, pattern, group)


def _is(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def _tabs(line: Column) -> Column:
    """Tabs in the white space a line begins with, as spaces to the next fourth column."""

    def widened(lead: Column) -> Column:
        width = F.aggregate(F.split(lead, ""), F.lit(0), lambda n, c: F.when(c == "\t", n + 4 - n % 4).otherwise(n + F.length(c)))
        return F.concat(F.repeat(F.lit(" "), width), _from(line, F.length(lead)))

    return F.when(F.contains(line, F.lit("\t")) & _is(line, r"^ *\t"), let(_matched(line, r"^[ \t]*"), widened)).otherwise(line)


def _blank(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\x0b\f")) == ""


def _first(text: Column) -> Column:
    """The first character but spaces: most rules need look no further."""
    return F.left(F.ltrim(text), F.lit(1))


def _rule(text: Column) -> Column:
    return _is(text, _RULE) & (F.length(F.replace(text, F.lit(" "), F.lit(""))) >= 3)


def _indent(text: Column) -> Column:
    return F.length(text) - F.length(F.ltrim(text))


# --- the state ------------------------------------------------------------------

_STATE = (
    "struct<nest:array<int>,fence:string,length:int,fence_depth:int,raw:int,raw_depth:int,para:boolean,"
    "out:array<string>,done:array<string>>"
)


_PLACE = ["nest", "fence", "length", "fence_depth", "raw", "raw_depth", "para"]


def _after(s: Column, add: Column | None = None, **changes: Column) -> Column:
    """What a line makes of the state, and the text that it adds (null: none).

    The text so far stays out of it: each value of a lambda is copied.
    """
    add = F.lit(None).cast("string") if add is None else add
    return F.struct(*[(changes[n] if n in changes else s[n]).alias(n) for n in _PLACE], add.alias("add"))


def _grown(s: Column, a: Column) -> Column:
    """The state ``s`` with the outcome ``a`` of a line.

    Lines are joined by the hundred: an array that grows line by line costs its square.
    """
    full = F.size(s["out"]) >= HELD
    out = F.when(full, F.array().cast("array<string>")).otherwise(s["out"])
    return F.struct(
        *[a[n].alias(n) for n in _PLACE],
        F.when(a["add"].isNull(), out).otherwise(F.concat(out, F.array(a["add"]))).alias("out"),
        F.when(full, F.concat(s["done"], F.array(F.array_join(s["out"], "\n")))).otherwise(s["done"]).alias("done"),
    )


def opening(carried: Column | None = None) -> Column:
    """The state at a cut: nothing but the fence or raw block carried over."""
    c = clean() if carried is None else carried
    return _struct(
        nest=F.array().cast("array<int>"),
        fence=c["fence"],
        length=c["length"],
        fence_depth=F.lit(0),
        raw=c["raw"],
        raw_depth=F.lit(0),
        para=F.lit(False),
        out=F.array().cast("array<string>"),
        done=F.array().cast("array<string>"),
    ).cast(_STATE)


def clean() -> Column:
    return _struct(fence=F.lit(""), length=F.lit(0), raw=F.lit(-1))


def carried(state: Column) -> Column:
    """What of a state is left at a cut."""
    fence = (state["fence"] != "") & (state["fence_depth"] == 0)
    raw = (state["raw"] >= 0) & (state["raw_depth"] == 0)
    return _struct(
        fence=F.when(fence, state["fence"]).otherwise(""),
        length=F.when(fence, state["length"]).otherwise(0),
        raw=F.when(raw, state["raw"]).otherwise(-1),
    )


# --- a line -----------------------------------------------------------------------


def _inside(nest: Column, line: Column) -> Column:
    """(at, depth): how many open containers the line is in, and where it goes on."""

    def one(acc: Column, indent: Column) -> Column:
        rest = _from(line, acc["at"])
        closed = _struct(at=acc["at"], depth=acc["depth"], open=F.lit(False))

        def on(n: Column) -> Column:
            return _struct(at=acc["at"] + n, depth=acc["depth"] + 1, open=F.lit(True))

        quoted = let(F.length(_matched(rest, _QUOTE)), lambda n: F.when(n > 0, on(n)).otherwise(closed))
        left = F.least(indent, F.length(rest))
        item = F.when(F.trim(F.left(rest, indent)) == "", on(left)).otherwise(closed)
        return F.when(~acc["open"], acc).when(indent == 0, quoted).otherwise(item)

    start = _struct(at=F.lit(0), depth=F.lit(0), open=F.lit(True))
    return F.when(F.size(nest) == 0, start).otherwise(F.aggregate(nest, start, one))


def _begun(nest: Column, depth: Column, para: Column, rest: Column) -> Column:
    """(nest, at, depth, kept, para) behind the container marks that a line begins with."""

    def one(acc: Column, _: Column) -> Column:
        sub = _from(rest, acc["at"])
        done = _struct(nest=acc["nest"], at=acc["at"], depth=acc["depth"], kept=acc["kept"], para=acc["para"], more=F.lit(False))

        def open_(indent: Column, behind: Column) -> Column:
            return _struct(
                nest=F.concat(F.slice(acc["nest"], F.lit(1), acc["depth"]), F.array(indent)),
                at=behind,
                depth=acc["depth"] + 1,
                kept=F.lit(True),
                para=F.lit(False),
                more=F.lit(True),
            )

        def item(m: Column) -> Column:
            def spaced(spaces: Column) -> Column:
                empty = acc["at"] + m["size"] + spaces == F.length(rest)
                wide = F.when(empty, 0).when(spaces > 4, 1).otherwise(spaces)
                barred = acc["para"] & acc["kept"] & (empty | ~m["number"].isin("", "1"))
                return F.when(barred, done).otherwise(
                    let(wide, lambda w: open_(m["size"] + F.greatest(w, F.lit(1)), acc["at"] + m["size"] + w))
                )

            spaces = F.length(_matched(_from(sub, m["size"]), "^ {0,5}"))
            return F.when((m["size"] == 0) | _rule(sub), done).otherwise(let(spaces, spaced))

        found = _struct(size=F.length(_matched(sub, _ITEM)), number=_matched(sub, _ITEM, 1))
        quoted = let(F.length(_matched(sub, _QUOTE)), lambda n: F.when(n > 0, open_(F.lit(0), acc["at"] + n)).otherwise(let(found, item)))
        return F.when(~acc["more"], acc).when(acc["depth"] >= MOST_NESTED, done).otherwise(quoted)

    start = _struct(nest=nest, at=F.lit(0), depth=depth, kept=depth == F.size(nest), para=para, more=F.lit(True))
    # No more containers can begin than the line has leading mark characters.
    marks = F.least(F.length(_matched(rest, r"^[ >*+\-0-9.)]*")), F.lit(MOST_NESTED))
    begins = F.contains(F.lit(">*+-0123456789"), _first(rest)) & _is(rest, r"^ {0,3}[^ ]")
    return F.when(begins, F.aggregate(F.sequence(F.lit(0), marks), start, one)).otherwise(start)


def _html(rest: Column, para: Column) -> Column:
    """The number of the raw HTML block that a line opens, or -1."""
    opens = F.when(_is(rest, "(?i)^ {0,3}" + HTML_BLOCKS[0][0]), 0)
    for i, (begin, _) in enumerate(HTML_BLOCKS[1:], 1):
        opens = opens.when(_is(rest, "(?i)^ {0,3}" + begin), i)
    opens = opens.when(_is(rest, _FLOW) | (~para & _is(rest, _ALONE)), BLANK_ENDED).otherwise(-1)
    return opens


def _html_ends(raw: Column, rest: Column) -> Column:
    ends = F.when(raw == BLANK_ENDED, _blank(rest))
    for i, (_, end) in enumerate(HTML_BLOCKS):
        ends = ends.when(raw == i, _is(rest, "(?i)" + end))
    return ends


def _fence_ends(char: Column, length: Column, rest: Column) -> Column:
    mark = F.rtrim(F.ltrim(F.rtrim(rest), F.lit(" ")))
    closes = (F.length(mark) >= length) & (F.replace(mark, F.lit("`"), F.lit("")) == "") & (char == "`")
    closes = closes | ((F.length(mark) >= length) & (F.replace(mark, F.lit("~"), F.lit("")) == "") & (char == "~"))
    return _is(rest, r"^ {0,3}[`~]+[ \t]*$") & closes


def _title(rest: Column) -> Column:
    """A heading's text, without its closing marks."""
    title = F.trim(F.ltrim(F.trim(rest), F.lit("#")))
    return let(
        title,
        lambda t: let(F.rtrim(t, F.lit("#")), lambda bare: F.when((bare == "") | bare.endswith(" "), bare).otherwise(t)),
    )


def _added(para: Column, line: Column) -> Column:
    """The line behind the others of its paragraph, or as a new block."""
    return F.when(para, line).otherwise(F.concat(F.lit(_MARK), line))


def _leaf(s: Column, c: Column, rest: Column) -> Column:
    """What the rest of a line behind its containers ``c`` makes of the state."""
    cut = F.slice(c["nest"], F.lit(1), c["depth"])
    free = {"fence": F.lit(""), "length": F.lit(0), "raw": F.lit(-1)}

    def kinds(k: Column) -> Column:
        lazy = ~c["kept"] & c["para"] & ~k["starts"]
        nest = F.when(c["kept"], c["nest"]).otherwise(cut)
        para = c["kept"] & c["para"]
        fence = F.concat(_matched(rest, _FENCE, 1), _matched(rest, _FENCE, 2))
        fenced = let(
            fence,
            lambda m: _after(s, **(free | {"nest": nest, "para": F.lit(False), "fence": F.left(m, F.lit(1)), "length": F.length(m), "fence_depth": c["depth"]})),
        )
        heading = _after(s, nest=nest, para=F.lit(False), add=_added(F.lit(False), _title(rest)), **free)
        ended = F.coalesce((k["html"] != BLANK_ENDED) & _html_ends(k["html"], rest), F.lit(False))
        html = _after(s, **(free | {"nest": nest, "para": F.lit(False), "raw": F.when(ended, -1).otherwise(k["html"]), "raw_depth": c["depth"]}))
        closed = _after(s, nest=nest, para=F.lit(False), **free)
        return (
            F.when(lazy, _after(s, nest=c["nest"], para=F.lit(True), add=_added(F.lit(True), F.trim(rest)), **free))
            .when(~para & (_indent(rest) >= 4), closed)  # indented code
            .when(para & ~k["plain"] & _is(rest, _UNDERLINE), closed)
            .when(~k["starts"], _after(s, nest=nest, para=F.lit(True), add=_added(para, F.ltrim(rest)), **free))
            .when(k["fenced"], fenced)
            .when(k["heading"], heading)
            .when(k["html"] >= 0, html)
            .otherwise(closed)
        )

    def judged(seen: Column) -> Column:
        plain, first = seen["plain"], seen["first"]
        found = _struct(
            plain=plain,
            html=F.when(~plain & (first == "<"), _html(rest, c["para"])).otherwise(-1),
            fenced=~plain & first.isin("`", "~") & _is(rest, _FENCE),
            heading=~plain & (first == "#") & _is(rest, _HEADING),
            rule=~plain & first.isin("*", "-", "_") & _rule(rest),
        )
        return let(
            found,
            lambda f: let(
                _struct(
                    plain=f["plain"],
                    html=f["html"],
                    fenced=f["fenced"],
                    heading=f["heading"],
                    starts=(f["html"] >= 0) | f["fenced"] | f["heading"] | f["rule"],
                ),
                kinds,
            ),
        )

    blank = _after(s, nest=cut, para=F.lit(False), **free)
    seen = _struct(plain=c["para"] & (_indent(rest) >= 4), first=_first(rest))
    return F.when(_blank(rest), blank).otherwise(let(seen, judged))


def step(s: Column, line: Column) -> Column:
    """The state after a line."""

    def inside(lead: Column, line: Column) -> Column:
        def placed(rest: Column) -> Column:
            in_fence = (s["fence"] != "") & (lead["depth"] >= s["fence_depth"])
            in_raw = (s["raw"] >= 0) & (lead["depth"] >= s["raw_depth"])
            fence_on = F.when(_fence_ends(s["fence"], s["length"], rest), _after(s, fence=F.lit(""), length=F.lit(0))).otherwise(_after(s))
            raw_on = F.when(_html_ends(s["raw"], rest), _after(s, raw=F.lit(-1))).otherwise(_after(s))
            free = let(
                _begun(s["nest"], lead["depth"], s["para"], rest),
                lambda c: let(_tabs(_from(rest, c["at"])), lambda r: _leaf(s, c, r)),
            )
            return F.when(in_fence, fence_on).when(in_raw, raw_on).otherwise(free)

        return let(_tabs(_from(line, lead["at"])), placed)

    outside = (F.size(s["nest"]) == 0) & (s["fence"] == "") & (s["raw"] < 0)
    ordinary = _after(s, para=F.lit(True), add=_added(s["para"], line))
    blank = _after(s, para=F.lit(False))
    ruled = let(_tabs(line), lambda x: let(_inside(s["nest"], x), lambda lead: inside(lead, x)))
    after = F.when(outside & _is(line, _ORDINARY), ordinary).when(outside & _blank(line), blank).otherwise(ruled)
    return let(after, lambda a: _grown(s, a))


# --- texts ------------------------------------------------------------------------


def body(text: Column) -> Column:
    """A text with ``\\n`` line ends, without front matter and NUL."""
    given = F.coalesce(text, F.lit(""))
    lines = F.when(F.contains(given, F.lit("\r")), F.regexp_replace(given, "\r\n?", "\n")).otherwise(given)
    clean = F.replace(lines, F.lit("\x00"), F.lit("�"))
    return let(clean, lambda t: F.when(_is(t, r"\A(?:---|\+\+\+)"), F.regexp_replace(t, _FRONT, "")).otherwise(t))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def read(lines: Column, carried: Column | None = None) -> Column:
    """The state after lines that begin at a cut."""
    return F.aggregate(lines, opening(carried), step)


def sources(state: Column) -> Column:
    """The inline source of each paragraph and heading, in order."""

    def parted(found: Column) -> Column:
        joined = F.array_join(found, "\n")
        return F.when(F.size(found) == 0, F.array().cast("array<string>")).otherwise(
            F.slice(F.split(joined, "\n?" + _MARK, -1), 2, 1 << 30)
        )

    # The state is a fold over all lines: taken as it is, it would be computed at each use.
    return let(state, lambda s: let(F.concat(s["done"], s["out"]), parted))


def definitions(source: Column) -> Column:
    """``struct(labels, texts, rest)``: link definitions that a paragraph begins with."""

    def group(i: int) -> Column:
        return F.regexp_extract_all(source, F.lit(_DEFINITION), F.lit(i))

    titles = F.transform(F.arrays_zip(group(2).alias("a"), group(3).alias("b"), group(4).alias("c")), lambda t: F.concat(t["a"], t["b"], t["c"]))
    texts = F.zip_with(group(1), titles, lambda label, title: F.concat(F.lit(_MARK), label, F.lit(" "), title))
    none = F.array().cast("array<string>")
    begins = _is(source, r"^ {0,3}\[")
    return _struct(
        labels=F.when(begins, F.transform(group(1), normal)).otherwise(none),
        texts=F.when(begins, texts).otherwise(none),
        rest=F.when(begins, F.regexp_replace(source, _DEFINITION, "")).otherwise(source),
    )


def normal(label: Column) -> Column:
    """A label in the form that labels are compared in."""
    return F.lower(F.upper(F.trim(F.regexp_replace(label, r"\s+", " "))))


def named(pieces: Column) -> Column:
    """Names in brackets that may refer to a definition."""
    return F.array_distinct(F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(r"\[([^\[\]]+)\]"), F.lit(1)))))


# --- chunks -----------------------------------------------------------------------

#: What a chunk makes of a carried state: the state after it from a clean start,
#: from each raw block (null: handed on), and from a fence of either kind, by
#: its length: ``[(longest, state)]`` for the fences of up to that length.
_CARRIED = "struct<fence:string,length:int,raw:int>"
EFFECT = f"struct<clean:{_CARRIED},raw:array<{_CARRIED}>,ticks:array<struct<longest:int,after:{_CARRIED}>>,tildes:array<struct<longest:int,after:{_CARRIED}>>>"


def chunks(text: Column, least: int) -> Column:
    """``text`` parted at cuts, each part ``least`` characters long or more (but the last)."""
    pattern = rf"(?s).{{{least},}}?(?:{CUT}|\z)|.+"
    return F.when(F.length(text) <= least, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def effect(lines: Column) -> Column:
    """What a chunk makes of any carried state, as a value of type ``EFFECT``."""

    def raw(kind: int) -> Column:
        """The line behind the end of a raw block (0: it does not end)."""
        if kind == BLANK_ENDED:
            ends = F.transform(lines, _blank)
        else:
            ends = F.transform(lines, lambda x: _is(x, "(?i)" + HTML_BLOCKS[kind][1]))
        return F.array_position(ends, True).cast("int")

    def fences(char: str) -> Column:
        """(length, line behind): where the longest fence that has ended so far grows."""
        lengths = F.transform(lines, lambda x: F.length(_matched(x, rf"^ {{0,3}}({char}{{3,}})[ \t]*$", 1)))
        return F.aggregate(
            F.arrays_zip(lengths.alias("n"), F.sequence(F.lit(1), F.size(lines)).alias("i")),
            F.array().cast("array<struct<n:int,i:int>>"),
            lambda out, x: F.when(
                x["n"] > F.coalesce(F.get(out, F.size(out) - 1)["n"], F.lit(0)),
                F.concat(out, F.array(F.struct(x["n"].alias("n"), x["i"].alias("i")))),
            ).otherwise(out),
        )

    def told(e: Column) -> Column:
        # From each of these lines on the chunk is read from a clean start.
        places = F.concat(F.array(F.lit(0)), e["raw"], F.transform(e["ticks"], lambda x: x["i"]), F.transform(e["tildes"], lambda x: x["i"]))
        rest = F.transform(
            F.array_distinct(places),
            lambda i: F.struct(i.alias("i"), let(read(F.slice(lines, i + 1, F.greatest(F.size(lines) - i, F.lit(0)))), carried).alias("after")),
        )

        def known(after: Column) -> Column:
            return F.struct(
                after[F.lit(0)].alias("clean"),
                F.transform(e["raw"], lambda i: F.when(i > 0, after[i])).alias("raw"),
                F.transform(e["ticks"], lambda x: _struct(longest=x["n"], after=after[x["i"]])).alias("ticks"),
                F.transform(e["tildes"], lambda x: _struct(longest=x["n"], after=after[x["i"]])).alias("tildes"),
            )

        return let(F.map_from_entries(rest), known)

    ends = _struct(raw=F.array(*[raw(k) for k in range(BLANK_ENDED + 1)]), ticks=fences("`"), tildes=fences("~"))
    return let(ends, told).cast(EFFECT)


def follow(effect: Column, before: Column) -> Column:
    """The state carried out of a chunk, from the one carried into it."""
    fences = F.when(before["fence"] == "`", effect["ticks"]).otherwise(effect["tildes"])
    ends = F.get(F.filter(fences, lambda f: f["longest"] >= before["length"]), F.lit(0))["after"]
    raw = F.get(effect["raw"], before["raw"])
    return (
        F.when(before["fence"] != "", F.coalesce(ends, before))
        .when(before["raw"] >= 0, F.coalesce(raw, before))
        .otherwise(effect["clean"])
    )
