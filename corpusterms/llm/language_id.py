"""Language identification by character language models.

One interpolated Kneser-Ney model per language, trained on a bounded sample
of labelled rows.  All models share sorted arrays of n-gram hashes; beside
each hash stands, for every language, the log probability of the n-gram's
last character after the others (for an n-gram that a language has never
seen, already backed off), and the log of its back-off weight as a context.
Every label is learnt; ``TOGETHER`` languages at a time share their arrays, so
that the models grow with the number of languages and not with its square.
A text is scored whole: each character costs one binary search, and more only
where its longest n-gram is unknown.  The language of the lowest
length-normalised cross-entropy wins.

*Rejection* is calibrated on training rows the models have not been fitted
on: per language, the highest cross-entropy that the rows of that language
show, plus a margin that shrinks with the length of the text.  Above it, the
text is in none of the languages.  A language of too few rows to hold any back
is fitted on all; as its models know these, its limit is the highest of the
other languages', if that is more than its own.

Defined results: a null text or one without a letter is ``und`` and rejected;
ties go to the language that sorts first; without a labelled row everything is
``und``; repeated rows are scored each; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, share, stored

UNKNOWN = "und"
ORDER = 4
#: Bound on the labelled rows that the models are fitted on, per language.
SAMPLE = 400
#: Languages whose models share arrays.
TOGETHER = 50
#: Below so many labelled rows, none is held back to calibrate.
FEW = 40
#: Characters of a batch scored at once.
SLICE = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_NOT_LETTER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower case, every run of other than letters one space, a space around."""
    core = _NOT_LETTER.sub(" ", (text or "").lower()).strip(" ")
    return f" {core} " if core else ""


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that *ends* at each place from ``order - 1`` on."""
    n = len(points) - order + 1
    h = np.full(max(n, 0), order, np.uint64)
    for i in range(order if n > 0 else 0):
        h = (h ^ points[i : n + i]) * _MULT
        h ^= h >> np.uint64(29)
    return h


def _find(sorted_hashes: np.ndarray, h: np.ndarray):
    if not len(sorted_hashes):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.searchsorted(sorted_hashes, h)
    at[at == len(sorted_hashes)] = 0
    return at, sorted_hashes[at] == h


def _log_probabilities(m: SimpleNamespace, grams: list[np.ndarray], order: int, ends: np.ndarray) -> np.ndarray:
    """Log p(character at ``ends`` | the ``order - 1`` before it), by language."""
    if order == 0:
        return np.tile(m.floor, (len(ends), 1))
    row, known = _find(m.hashes[order - 1], grams[order - 1][ends - (order - 1)])
    out = m.logp[order - 1][row] if known.any() else np.empty((len(ends), len(m.languages)), np.float32)
    rest = np.flatnonzero(~known)
    if len(rest):
        lower = _log_probabilities(m, grams, order - 1, ends[rest])
        if order > 1:  # the context ends a place earlier
            row, known = _find(m.hashes[order - 2], grams[order - 2][ends[rest] - (order - 1)])
            lower[known] += m.back[order - 2][row[known]]
        out[rest] = lower
    return out


def cross_entropies(m: SimpleNamespace, text: str) -> tuple[np.ndarray, int]:
    """Nats a character by language, and how many characters were scored."""
    total = np.zeros(len(m.languages))
    scored = max(len(text) - 1, 0)  # the first, a space, is context only
    for lo in range(1, len(text), SLICE):
        begin = max(0, lo - (ORDER - 1))
        points = _points(text[begin : lo + SLICE])
        grams = [gram_hashes(points, k) for k in range(1, ORDER + 1)]
        for e in range(lo - begin, min(ORDER - 1, len(points))):  # too near the start for a whole n-gram
            total += _log_probabilities(m, grams, e + 1, np.array([e]))[0]
        if len(points) >= ORDER:
            total += _log_probabilities(m, grams, ORDER, np.arange(ORDER - 1, len(points))).sum(0, dtype=np.float64)
    return (-total / scored if scored else total), scored


def fit(rows: pa.Table, alphabet: int | None = None) -> SimpleNamespace:
    """Interpolated Kneser-Ney from counts of n-grams by language.

    ``hashes[k]`` is sorted; ``logp[k]`` and ``back[k]`` have a row for each of
    them and a column for each language.  ``alphabet``: how many characters
    all languages have, these and any others; so models fitted apart give what
    they give when fitted together.
    """
    col = {c: np.array(rows.column(c)) for c in ("order", "gram", "context", "tail", "count")}
    for c in ("gram", "context", "tail"):
        col[c] = col[c].astype(np.int64).view(np.uint64)
    spoken = np.array(rows.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(spoken))
    of = [col["order"] == k for k in range(1, ORDER + 1)]
    found = [np.unique(col["gram"][o], return_index=True) for o in of]
    hashes = [f[0] for f in found]
    size = [len(h) for h in hashes]
    logp = [np.zeros((s, len(languages)), np.float32) for s in size]
    back = [np.zeros((s, len(languages)), np.float32) for s in size]
    ahead = [np.zeros(s, np.int64) for s in size]  # row of the context, an order lower
    tail = [np.zeros(s, np.int64) for s in size]  # row of the shorter n-gram
    for k in range(2, ORDER + 1):
        ahead[k - 1] = np.searchsorted(hashes[k - 2], col["context"][of[k - 1]][found[k - 1][1]])
        tail[k - 1] = np.searchsorted(hashes[k - 2], col["tail"][of[k - 1]][found[k - 1][1]])
    alphabet = max(alphabet or size[0], 1)
    floor = np.full(len(languages), -np.log(alphabet + 1.0), np.float32)
    for j, lang in enumerate(languages):
        seen = []
        for k in range(1, ORDER + 1):
            own = of[k - 1] & (spoken == lang)
            counts = np.zeros(size[k - 1])
            counts[np.searchsorted(hashes[k - 1], col["gram"][own])] = col["count"][own]
            seen.append(counts)
        lower = np.full(size[0], 1.0 / (alphabet + 1))
        for k in range(1, ORDER + 1):
            # The longest n-grams count as they occur; shorter ones by how
            # many different characters they follow (continuation counts).
            count = seen[k - 1] if k == ORDER else np.bincount(tail[k], weights=seen[k] > 0, minlength=size[k - 1])
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context = ahead[k - 1] if k > 1 else np.zeros(size[0], np.int64)
            n = size[k - 2] if k > 1 else 1
            mass = np.bincount(context, weights=count, minlength=n)
            kinds = np.bincount(context, weights=count > 0, minlength=n)
            weight = np.where(mass > 0, discount * kinds / np.maximum(mass, 1), 1.0)
            base = np.maximum(count - discount, 0) / np.maximum(mass, 1)[context]
            prob = base + weight[context] * lower
            logp[k - 1][:, j] = np.log(prob)
            if k > 1:
                back[k - 2][:, j] = np.log(weight)
            else:
                floor[j] = np.log(weight[0] / (alphabet + 1)) if weight[0] > 0 else floor[j]
            if k < ORDER:
                lower = prob[tail[k]]
    return SimpleNamespace(languages=languages, hashes=hashes, logp=logp, back=back, floor=floor, limit=None)


GRAMS = "lang string, order int, gram long, context long, tail long, count long"


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            points = _points(letters(text.as_py()))
            if not len(points):
                continue
            grams = [gram_hashes(points, k) for k in range(1, ORDER + 1)]
            for k in range(1, ORDER + 1):
                gram, first, count = np.unique(grams[k - 1], return_index=True, return_counts=True)
                shorter = grams[k - 2] if k > 1 else np.zeros(len(points) + 1, np.uint64)
                cols = [gram.view(np.int64), shorter[first].view(np.int64), shorter[first + 1].view(np.int64), count]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.as_py()] * len(gram)), pa.array(np.full(len(gram), k, np.int32))]
                    + [pa.array(c, pa.int64()) for c in cols],
                    [c.split()[0] for c in GRAMS.split(", ")],
                )


def _margin(scored):
    """How far above the calibrated limit a text of this length may lie."""
    return 1.0 + 3.0 / np.sqrt(np.maximum(scored, 1))


def train(labelled: DataFrame, sample: int = SAMPLE, together: int = TOGETHER) -> SimpleNamespace | None:
    """Models from ``labelled(doc_id, text, lang)``; None without usable rows.

    About ``sample`` rows for each label, drawn by a hash of ``doc_id`` and
    text: three quarters to fit, one to calibrate, or all for both where a
    label has few.
    """
    labelled = labelled.where("lang is not null").select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return None
    spark = labelled.sparkSession
    kind = "lang string, rate double, few boolean"
    given = [(r["lang"], float(min(1.0, sample / r["count"])), r["count"] < FEW) for r in counts]
    drawn = labelled.join(F.broadcast(spark.createDataFrame(given, kind)), "lang")
    drawn = drawn.where(share("doc_id", "text", F.lit("drawn")) < F.col("rate"))
    fitted = share("doc_id", "text", F.lit("fitted")) < 0.75
    grams = drawn.where(F.col("few") | fitted).select("lang", "text").mapInArrow(_count_grams, GRAMS)
    grams = grams.groupBy("lang", "order", "gram").agg(
        F.first("context").alias("context"), F.first("tail").alias("tail"), F.sum("count").alias("count")
    )
    groups = []
    if len(counts) <= together:
        rows = grams.toArrow()
        groups = [fit(rows)] if rows.num_rows else []
    else:
        grams = stored(grams, f"{scratch(spark)}/grams")
        alphabet = grams.where("order = 1").select("gram").distinct().count()
        for lo in range(0, len(counts), together):
            rows = grams.where(F.col("lang").isin([r["lang"] for r in counts[lo : lo + together]])).toArrow()
            groups += [fit(rows, alphabet)] if rows.num_rows else []
    if not groups:
        return None
    # Labels are sorted, so the groups' languages in a row are, too.
    models = SimpleNamespace(groups=groups, languages=[lang for g in groups for lang in g.languages], limit=None)
    held = drawn.where(F.col("few") | ~fitted).select(F.struct("lang", "text").alias("row"))
    scored = held.mapInArrow(_scorer(models), _scored_type(held))
    tops = (
        scored.where("row.lang = lang_pred")
        .groupBy("lang_pred")
        .agg(F.max(F.col("cross_entropy")).alias("top"))
        .collect()
    )
    top = {r["lang_pred"]: r["top"] for r in tops}
    few = {lang for lang, _, is_few in given if is_few}
    spare = max((t for lang, t in top.items() if lang not in few), default=max(top.values(), default=np.inf))
    models.limit = np.array([max(top.get(lang, spare), spare) if lang in few else top.get(lang, spare) for lang in models.languages])
    return models


def _scored_type(df: DataFrame) -> str:
    row = df.schema["row"].dataType.simpleString()
    return f"row {row}, lang_pred string, score double, cross_entropy double, accepted boolean"


def _scorer(m: SimpleNamespace | None):
    def predict(text: str | None):
        core = letters(text)
        if m is None or not core:
            return UNKNOWN, 0.0, None, False
        found = [cross_entropies(g, core) for g in m.groups]
        nats, scored = np.concatenate([f[0] for f in found]), found[0][1]
        best = int(np.argmin(nats))  # the first, alphabetically, of equals
        score = 1.0 / np.exp(-(nats - nats[best]) * min(scored, 50)).sum()
        ok = m.limit is None or nats[best] <= m.limit[best] + _margin(scored)
        return m.languages[best], float(score), float(nats[best]), bool(ok)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0)
            found = [predict(t.as_py()) for t in rows.field("text")]
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            cols = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([rows, *cols], ["row", "lang_pred", "score", "cross_entropy", "accepted"])

    return run


def identify(docs: DataFrame, models: SimpleNamespace | None) -> DataFrame:
    """``(row struct of docs' columns, lang_pred, score, cross_entropy, accepted)``.

    ``lang_pred`` is the best language even where ``accepted`` is false, and
    ``und`` only without a letter (or without models).
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(_scorer(models), _scored_type(rows))


def held_out() -> Column:
    """One row in five, by ``doc_id``; none without one."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drop_unknown(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a language learnt from its labelled rows, all of them."""
    return identify(docs, train(docs)).where("accepted").select("row.*")
