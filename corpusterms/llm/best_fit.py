"""Packing a whole corpus by best fit decreasing into as few sequences as it can.

1. *Pieces.*  Each task encodes its documents (an end id after each), cuts
   those longer than a sequence into whole sequences and a rest, and numbers
   its pieces of every length.  The pieces are stored with their ids.
2. *Histogram.*  How many pieces of each length every task has, summed up
   length by length over the tasks: each piece now has a rank among all pieces
   of its length.  The totals are at most one number a length.
3. *Plan.*  Best fit decreasing over the totals, longest first.  Open bins are
   held in a segment tree over their remaining capacities; the tightest bins
   that still hold a piece are found in the logarithm of the sequence length.
   Pieces of one length and bins of one room are alike, so a step places a
   whole run of pieces: the outcome is that of best fit decreasing document by
   document over the *whole* corpus, whatever the number of tasks.
4. *Placing.*  A piece finds its run by (length, rank): its sequence and offset.

What reaches the driver is the totals (one row a length); what goes to the
tasks is the runs.  A step either uses up the bins it takes or the pieces of
its length, and the lengths placed in one bin add up to no more than a
sequence, so there are at most some ``5 * size * sqrt(2 * size)`` runs.

Defined results: a null or empty text is its end id alone; repeated rows are
packed each; a null ``doc_id`` stays null; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, stored
from .word_bpe import encode, words

PIECES = "doc_id long, piece int, start long, length long, ids binary, task int, rank long"


class OpenBins:
    """Runs of open bins by remaining capacity, under a segment tree.

    A node holds the largest remaining capacity below it that has open bins
    (0: none), so the tightest capacity of at least ``need`` is found by one
    walk up and one down.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.most = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _set(self, room: int, value: int) -> None:
        node = self.leaves + room
        self.most[node] = value
        while node > 1:
            node >>= 1
            self.most[node] = max(self.most[2 * node], self.most[2 * node + 1])

    def add(self, first: int, count: int, room: int) -> None:
        if count and room:
            self.runs[room].append((first, count))
            if len(self.runs[room]) == 1:
                self._set(room, room)

    def tightest(self, need: int) -> int:
        """The least capacity of ``need`` or more that has open bins, or 0."""
        node = self.leaves + need
        if self.most[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.most[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.most[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return 0

    def take(self, room: int) -> tuple[int, int]:
        """A run (first bin, number of bins) of that capacity, taken out."""
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._set(room, 0)
        return run


def plan(totals: dict[int, int], size: int) -> np.ndarray:
    """Runs (length, first rank, first bin, pieces a bin, offset), by length and rank.

    The pieces of ``length`` with ranks from ``first rank`` on, up to the next
    run's, fill bins from ``first bin`` on, so many in each, from ``offset``.
    """
    space, opened, runs = OpenBins(size), 0, []
    for length in sorted(totals, reverse=True):
        left, rank = totals[length], 0
        while left:
            room = space.tightest(length)
            if room:
                first, count = space.take(room)
            else:
                room, first, count = size, opened, -(-left // (size // length))
                opened += count
            each = room // length
            full = min(count, left // each)
            rest = left - full * each if full < count else 0
            used = full + (1 if rest else 0)
            runs.append((length, rank, first, each, size - room))
            space.add(first, full, room - each * length)
            if rest:
                space.add(first + full, 1, room - rest * length)
            space.add(first + used, count - used, room)
            placed = full * each + rest
            left, rank = left - placed, rank + placed
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def _cutter(vocabulary: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, table = TaskContext.get().partitionId(), words(vocabulary)
        end, seen = np.array([end_id], "<u4"), np.zeros(size + 1, np.int64)
        rows: list[tuple] = []
        held = 0

        def batch():
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                ids = np.concatenate([encode(table, raw), end])
                for number, start in enumerate(range(0, len(ids), size)):
                    part = ids[start : start + size]
                    rows.append((key.as_py(), number, start, len(part), part.tobytes(), task, int(seen[len(part)])))
                    seen[len(part)] += 1
                    held += len(part)
                    if held >= 1_000_000:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    return run


def cut_pieces(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """A stored row per piece with its ids, and its rank in its task and length."""
    bounded_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(given.mapInArrow(_cutter(vocabulary, size, end_id), PIECES), path)


def _placer(runs: np.ndarray, names: list[str]):
    # (length, rank) as one number: ranks stay far below 2^48.
    keys = (runs[:, 0] << 48) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(names.index("rank")).to_numpy(zero_copy_only=False)
            at = runs[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            nth = rank - at[:, 1]
            sequence, offset = at[:, 2] + nth // at[:, 3], at[:, 4] + nth % at[:, 3] * length
            out = [b.column(i) for i, n in enumerate(names) if n != "rank"]
            kept = [n for n in names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*kept, "sequence_id", "offset"]
            )

    return run


def place(pieces: DataFrame, counted: DataFrame | None = None, size: int = 2048) -> DataFrame:
    """The rows of ``pieces`` with ``sequence_id`` and ``offset`` in place of ``task`` and ``rank``.

    ``counted`` is the stored table to count lengths from, where ``pieces``
    leaves columns of it out.
    """
    spark = pieces.sparkSession
    counts = (pieces if counted is None else counted).groupBy("task", "length").agg(F.count(F.lit(1)).alias("pieces"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", "pieces", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("base"))
    base = stored(base, f"{scratch(spark)}/lengths")
    totals = {r.length: r.total for r in base.groupBy("length").agg(F.sum("pieces").alias("total")).collect()}
    ranked = pieces.join(base.select("task", "length", "base"), ["task", "length"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("task", "base")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(_placer(plan(totals, size), ranked.columns), f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece: its ids, and where it lies in which sequence."""
    return place(cut_pieces(docs, vocabulary, size, end_id), size=size)
