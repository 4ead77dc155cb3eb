"""Counting quotient filters of packed n-grams: lossless, compact, mergeable.

A key is an n-gram of word ids of ``width`` bits each.  A Feistel network over
those ids permutes the keys invertibly, so that they spread evenly; a permuted
key's upper bits are its *quotient*, all its other bits its *remainder*.  A
filter holds its keys in order: how many keys each quotient has, the full
remainders, and the counters.  Nothing is hashed away, so the keys come back
exactly, and filters of several shards merge like sorted lists.

A key is held as one array per id: ``n`` arrays of unsigned 64-bit numbers.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np

Keys = list[np.ndarray]
ROUNDS = 3


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """The finalizer of SplitMix64, a public bit mixer."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rounds(n: int):
    for r in range(ROUNDS):
        for i in range(n):
            yield i, (i - 1) % n, 0x9E3779B97F4A7C15 * (n * r + i + 1) % 2**64


def permuted(keys: Keys, width: int) -> Keys:
    """Each id in turn is xored with a mix of the one before it, three times round."""
    keys, mask = list(keys), np.uint64(2**width - 1)
    for i, by, salt in _rounds(len(keys)):
        keys[i] = keys[i] ^ (_mixed(keys[by], salt) & mask)
    return keys


def restored(keys: Keys, width: int) -> Keys:
    keys, mask = list(keys), np.uint64(2**width - 1)
    for i, by, salt in reversed(list(_rounds(len(keys)))):
        keys[i] = keys[i] ^ (_mixed(keys[by], salt) & mask)
    return keys


def _new(keys: Keys) -> np.ndarray:
    """Where a key differs from the one before it."""
    out = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        out |= k[1:] != k[:-1]
    return np.concatenate([np.ones(min(1, len(keys[0])), bool), out])


def order(keys: Keys) -> np.ndarray:
    """The order of the keys; runs that are in order are merged in linear time."""
    found = np.argsort(keys[0], kind="stable")
    lead = keys[0][found]
    # Keys that share their first part with a different key: few, sorted anew.
    tied = np.concatenate([lead[1:] == lead[:-1], np.zeros(min(1, len(lead)), bool)])
    if tied.any():
        tied[1:] |= tied[:-1].copy()
        at = np.flatnonzero(tied)
        some = found[at]
        found[at] = some[np.lexsort([k[some] for k in reversed(keys)])]
    return found


def merged(keys: Keys, counts: np.ndarray) -> tuple[Keys, np.ndarray]:
    """Keys in order, each once, with the sum of its counts."""
    if not len(counts):
        return keys, counts
    by = order(keys)
    keys, counts = [k[by] for k in keys], counts[by]
    first = np.flatnonzero(_new(keys))
    return [k[first] for k in keys], np.add.reduceat(counts, first)


def _packed(x: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _unpacked(raw: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size if size else 0, 8), np.uint8)
    out[:, :size] = raw.reshape(-1, size)
    return out.reshape(-1).view("<u8")


def _small(x: np.ndarray) -> bytes:
    """Numbers a byte each; those of 255 or more follow in full."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<u8").tobytes()


def _size(bits: int) -> int:
    return -(-bits // 8)


def dump(keys: Keys, counts: np.ndarray, width: int, shared: int) -> bytes:
    """A filter as bytes, of permuted keys in order that share their first ``shared`` bits."""
    n = len(counts)
    quotient = max(0, min(width - shared, n.bit_length() - 1))
    rest = width - shared - quotient
    lead = keys[0] & np.uint64(2 ** (width - shared) - 1)
    slots = np.bincount((lead >> np.uint64(rest)).astype(np.int64), minlength=1 << quotient)
    head = np.array([n, quotient, int(keys[0][0]) >> (width - shared) if shared else 0], "<u8").tobytes()
    tail = [_packed(k, _size(width)) for k in keys[1:]]
    remainder = _packed(lead & np.uint64(2**rest - 1), _size(rest)) if rest else b""
    return b"".join([head, _small(slots), remainder, *tail, _small(counts)])


def load(raw: bytes, n: int, width: int, shared: int) -> tuple[Keys, np.ndarray]:
    """The permuted keys, in order, and counts of a filter of ``n``-grams."""
    data = np.frombuffer(raw, np.uint8)
    held, quotient, prefix = (int(x) for x in data[:24].view("<u8"))
    at = 24

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return data[at - size : at]

    def small(count: int) -> np.ndarray:
        low = take(count).astype(np.int64)
        big = np.flatnonzero(low == 255)
        low[big] = np.frombuffer(take(8 * len(big)).tobytes(), "<u8").astype(np.int64)
        return low

    slots = small(1 << quotient)
    rest = width - shared - quotient
    lead = np.repeat(np.arange(1 << quotient, dtype=np.uint64), slots)
    if rest:
        lead = (lead << np.uint64(rest)) | _unpacked(take(held * _size(rest)), _size(rest))
    if shared:
        lead = lead | np.uint64(prefix << (width - shared))
    tail = [_unpacked(take(held * _size(width)), _size(width)) for _ in range(n - 1)]
    return [lead, *tail], small(held)


def split(keys: Keys, counts: np.ndarray, width: int, shared: int):
    """``(first bits, filter)`` for each value of the first ``shared`` bits that has keys."""
    if not len(counts):
        return
    first = (keys[0] >> np.uint64(width - shared)).astype(np.int64) if shared else np.zeros(len(counts), np.int64)
    cuts = [*np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])), len(first)]
    for lo, hi in pairwise(cuts):
        yield int(first[lo]), dump([k[lo:hi] for k in keys], counts[lo:hi], width, shared)
