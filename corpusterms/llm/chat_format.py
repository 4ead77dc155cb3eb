"""Chat formatting by prefix-target expansion.

Every assistant turn of a conversation becomes an example of its own: all
turns before it as context, and that reply alone under the loss mask.  A
conversation that does not end with an assistant turn gives one more example
with no target, so that no turn is lost.

Template (a user, system, assistant turn, and one of any other role)::

    <s>[INST] text [/INST]   <s>[SYS] text [/SYS]   text</s>   <s>[ROLE=tool] text [/ROLE]

Control strings begin with ``<`` or ``[``.  In texts and role names ``\\``,
``<`` and ``[`` (in names ``]`` too) are written with a ``\\`` before them, so
that no text can hold a control string, and reading back is exact.

The turns of a conversation are gathered in one row (every example holds all
that precedes it, so the last one is as long as the conversation); examples
leave the task one by one and only what is asked of them moves on.

Defined results: a null text is empty, a null role is the empty role; turns
of one number are ordered by role, then text; repeated rows are turns each; a
null ``conv_id`` is a conversation; an empty table gives no examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPED = re.compile(r"([\\<\[\]])")
UNESCAPED = re.compile(r"\\(.)", re.S)
#: What opens a turn and what closes it.
TURN = {
    "user": ("<s>[INST] ", " [/INST]"),
    "system": ("<s>[SYS] ", " [/SYS]"),
    "assistant": ("<s>", "</s>"),
}
_CLOSE = re.compile(r"([^\\<\[]*+(?:\\.[^\\<\[]*+)*+)(?:\[/(?:INST|SYS|ROLE)\]|</s>)", re.S)
_OPEN = re.compile(r"<s>(?:\[(INST|SYS)\] |\[ROLE=([^\\\[\]<]*+(?:\\.[^\\\[\]<]*+)*+)\] )?", re.S)

EXAMPLES = "conv_id long, example long, turns long, text string, loss_start long, loss_end long"
#: Characters of examples in one Arrow batch.
BATCH = 4 << 20


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(r"\1", text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    opened, closed = TURN.get(role) or (f"<s>[ROLE={escape(role)}] ", " [/ROLE]")
    return opened, escape(text), closed


def read_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example."""
    found, at = [], 0
    names = {"INST": "user", "SYS": "system"}
    while at < len(text):
        opened = _OPEN.match(text, at)
        closed = _CLOSE.match(text, opened.end())
        role = unescape(opened[2]) if opened[2] is not None else names.get(opened[1], "assistant")
        said = closed[1] if role == "assistant" else closed[1][:-1]  # the space before the end mark
        found.append((role, unescape(said)))
        at = closed.end()
    return found


def conversations_of(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns array<struct<turn, role, text>>)`` in order."""
    item = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(item)).alias("turns")
    )


def _examples(turns: list[dict]):
    """(turns, text, loss start, loss end) of each example."""
    pieces, length = [], 0
    for i, t in enumerate(turns):
        opened, text, closed = turn_parts(t["role"], t["text"])
        pieces.append(opened + text + closed)
        if t["role"] == "assistant":
            start = length + len(opened)
            yield i + 1, "".join(pieces), start, start + len(text)
        length += len(pieces[-1])
    if turns and turns[-1]["role"] != "assistant":
        yield len(turns), "".join(pieces), length, length


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in EXAMPLES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    rows, held = [], 0
    for b in batches:
        for conv, turns in zip(b.column(0), b.column(1), strict=True):
            for i, (count, text, start, end) in enumerate(_examples(turns.as_py())):
                rows.append((conv.as_py(), i, count, text, start, end))
                held += len(text)
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def format_conversations(turns: DataFrame) -> DataFrame:
    """A row per example: ``conv_id, example, turns, text, loss_start, loss_end``.

    ``example`` counts from 0; the loss mask covers the code points of
    ``text`` from ``loss_start`` up to ``loss_end``.
    """
    return conversations_of(turns).mapInArrow(_expand, EXAMPLES)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each example: its masked text, its length, a digest of its turns."""
    for b in batches:
        loss, chars, count, digest = [], [], [], []
        for text, start, end in zip(*(b.column(c).to_pylist() for c in ("text", "loss_start", "loss_end")), strict=True):
            turns = read_turns(text)
            loss.append(unescape(text[start:end]))
            chars.append(len(text))
            count.append(len(turns))
            digest.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), b.column("example"), pa.array(loss, pa.string())]
            + [pa.array(chars, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())],
            ["conv_id", "example", "loss", "chars", "n_turns", "turns_sha256"],
        )


def read_back(examples: DataFrame) -> DataFrame:
    """What the formatted examples say of each conversation.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``:
    the turns are those of its longest example, the masked texts follow one
    another in the examples' order, ``formatted_chars`` are the code points of
    all its examples.
    """
    kind = "conv_id long, example long, loss string, chars long, n_turns long, turns_sha256 string"
    each = examples.select(*[c.split()[0] for c in EXAMPLES.split(", ")]).mapInArrow(_read_back, kind)
    whole = each.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max_by("turns_sha256", "n_turns").alias("turns_sha256"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    whole = whole.withColumn("loss", F.array_join(F.transform("losses", lambda x: x["loss"]), ""))
    return whole.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
