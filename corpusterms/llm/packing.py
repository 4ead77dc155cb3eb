"""Packing documents into fixed-length sequences, best fit decreasing.

Each task encodes its documents (an end id after each), cuts overlong ones
into full windows first, and packs the rest by best fit decreasing: pieces in
order of falling length, each into the open window with the least room that
still holds it.  The open windows are counted in a segment tree indexed by
remaining capacity, so a piece is placed in the logarithm of the window
length.  Nothing is shuffled; a task packs what it holds each time it has
gathered ``held`` ids, so memory is bounded whatever the input's size, and
padding is a fraction of a window for every such batch.

Defined results: a null or empty text is its end id alone; a document longer
than a window spans several; repeated rows are packed each; an empty table
gives no rows; further columns are ignored.  ``sequence_id`` is the task's
number in the upper bits and a count in the lower ones, the same after a retry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import added_tokens, encode, encoding
from .common import bounded_batches

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, padded_length long"
)
#: Ids that a task gathers before it packs them.
HELD = 4_000_000


class OpenWindows:
    """Open windows by remaining capacity, 0 to ``size``, under a segment tree.

    A node holds how many open windows its range of capacities has.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, window: int, room: int) -> None:
        if room:
            self.stacks[room].append(window)
            self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest window with room for ``need``, taken out: (window, room)."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            # Up to the first right sibling that has windows, then down left.
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return self.stacks[room].pop(), room


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset) by piece, and the number of windows."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    space, opened = OpenWindows(size), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        got = space.take(need)
        if got is None:
            got, opened = (opened, size), opened + 1
        window[i], offset[i] = got[0], size - got[1]
        space.add(got[0], got[1] - need)
    return window, offset, opened


def padded(length: int, size: int) -> int:
    """Sequences are padded to the window, except at a power of two."""
    return length if length & (length - 1) == 0 else size


def _packer(vocabulary: str, pattern: str, size: int, end_id: int, held: int):
    def pack(docs, task: int, first: int):
        keys, whole, starts, ends, lengths = [], [], [], [], []
        for i, (_, ids) in enumerate(docs):
            cuts = range(0, len(ids), size)
            for s in cuts:
                whole.append(i)
                starts.append(s)
                ends.append(min(s + size, len(ids)))
                lengths.append(ends[-1] - s)
        lengths = np.array(lengths, np.int64)
        window, offset, opened = best_fit(lengths, size)
        filled = np.bincount(window, weights=lengths, minlength=opened).astype(np.int64)
        pad = np.array([padded(int(x), size) for x in filled], np.int64)
        keys = [docs[i][0] for i in whole]
        blobs = [docs[i][1][s:e].tobytes() for i, s, e in zip(whole, starts, ends, strict=True)]
        total = [len(docs[i][1]) for i in whole]
        for lo in range(0, len(lengths), 4096):
            hi = lo + 4096
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[lo:hi], pa.int64()),
                    pa.array(starts[lo:hi], pa.int64()),
                    pa.array(lengths[lo:hi], pa.int64()),
                    pa.array(blobs[lo:hi], pa.binary()),
                    pa.array(total[lo:hi], pa.int64()),
                    pa.array((task << 40) + first + window[lo:hi], pa.int64()),
                    pa.array(offset[lo:hi], pa.int64()),
                    pa.array(pad[window[lo:hi]], pa.int64()),
                ],
                [c.split()[0] for c in PIECES.split(", ")],
            )
        return opened

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, first = TaskContext.get().partitionId(), 0
        enc, end = encoding(vocabulary, pattern), np.array([end_id], "<u4")
        added = added_tokens(vocabulary)
        docs, gathered = [], 0
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                ids = np.concatenate([encode(enc, text.as_py(), added), end])
                docs.append((key.as_py(), ids))
                gathered += len(ids)
                if gathered >= held:
                    first += yield from pack(docs, task, first)
                    docs, gathered = [], 0
        if docs:
            yield from pack(docs, task, first)

    return run


def pack_documents(
    docs: DataFrame, vocabulary: str, pattern: str, size: int = 1024, end_id: int = 0, held: int = HELD
) -> DataFrame:
    """A row per piece: its ids, and where it lies in which sequence."""
    bounded_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_packer(vocabulary, pattern, size, end_id, held), PIECES)
