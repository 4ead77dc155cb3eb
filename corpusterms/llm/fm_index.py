"""A bidirectional FM-index of a delimited vocabulary, and searches with one error.

The words of a vocabulary, each once, are written one after another between
delimiters.  The suffixes of this text have ranks; the places that a string
occurs at are an interval of them, and the interval of the string with one
more character *before* it follows from the counts of that character in the
Burrows-Wheeler transform.  The same over the reversed text adds a character
*behind* the string; both intervals are kept in step while a search matches in
one direction, so that it can turn round and extend in the other.

A search scheme for one error: a word and one that is an edit away agree
exactly in what lies before the edit and behind it, so one of the word's
halves occurs in the other unchanged.  Each half is matched exactly, from its
inner end to the delimiter, then the search turns round and extends across the
other half, allowing the error there.

All queries advance together: an interval is a row of numpy arrays.
"""

from __future__ import annotations


import numpy as np

#: Queries that are searched together.
CHUNK = 20_000
#: Characters of a search after which equal states are merged.
LONG = 32


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the length that their ranks stand for."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    length = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - length] = rank[length:] + 1
        key = rank * (n + 1) + behind
        found = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[found]) > 0)])
        rank = np.empty(n, np.int64)
        rank[found] = new
        if new[-1] == n - 1:
            return found
        length *= 2


class Half:
    """One direction of the index: a wavelet matrix over a Burrows-Wheeler transform."""

    def __init__(self, text: np.ndarray, letters: int):
        # Within the index a character is one more: 0 is the text's end, which nothing matches.
        text = np.concatenate([text + 1, [0]])
        self.places = suffix_array(text)
        bwt = text[self.places - 1]
        self.before = np.maximum(bwt - 1, 0)  # the characters before the suffixes, for reading
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=letters + 1))])
        self.levels, left = [], bwt.astype(np.int64)
        for bit in reversed(range(letters.bit_length())):
            ones = left >> bit & 1
            zeros = np.concatenate([[0], np.cumsum(1 - ones)]).astype(np.int32)
            self.levels.append((bit, zeros))
            left = left[np.argsort(ones, kind="stable")]

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """The interval with ``c`` in front, and how many in it come before ``c``.

        A level of the matrix deals the characters by one bit, zeros first; an
        interval is followed down the levels by counting.
        """
        c = c + 1
        a, b, less = lo, hi, np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            za, zb, one = zeros[a].astype(np.int64), zeros[b].astype(np.int64), (c >> bit & 1).astype(bool)
            less += np.where(one, zb - za, 0)
            total = int(zeros[-1])
            a, b = np.where(one, total + a - za, za), np.where(one, total + b - zb, zb)
        # What is left are the ``c`` themselves; those before ``lo`` give the rank.
        start = self._start(c)
        return self.first[c] + a - start, self.first[c] + b - start, less

    def _start(self, c: np.ndarray) -> np.ndarray:
        """Where the run of each character begins on the last level."""
        if not hasattr(self, "starts"):
            letters = np.arange(len(self.first) - 1)
            a = np.zeros(len(letters), np.int64)
            for bit, zeros in self.levels:
                za, one = zeros[a].astype(np.int64), (letters >> bit & 1).astype(bool)
                a = np.where(one, int(zeros[-1]) + a - za, za)
            self.starts = a
        return self.starts[c]


class Index:
    """``words`` (distinct, without the delimiter) between delimiters, in both directions."""

    def __init__(self, words: list[str]):
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.alphabet = np.unique(points)
        self.lengths = np.array([len(w) for w in words], np.int64)
        # The text: a delimiter (0), then each word with a delimiter behind it.
        self.starts = 1 + np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        text = np.zeros(1 + len(points) + len(words), np.int64)
        inside = np.ones(len(text), bool)
        inside[0] = False
        inside[self.starts + self.lengths] = False
        text[inside] = np.searchsorted(self.alphabet, points) + 1
        self.text, self.letters = text, len(self.alphabet) + 1
        self.word_at = np.zeros(len(text), np.int64)
        self.word_at[self.starts] = np.arange(len(words))
        # ``left`` puts characters in front, ``right`` (the reversed text) behind.
        self.left, self.right = Half(text, self.letters), Half(text[::-1].copy(), self.letters)

    def near(self, query: np.ndarray, head: np.ndarray, tail: np.ndarray, backward: bool):
        """``(pairs, asker)``: (query, word) one edit apart, the edit between ``head`` and ``tail``.

        A query is a word of the index; its first ``head`` and last ``tail``
        characters occur unchanged.  The search begins with the head and goes
        on behind it, or (``backward``) with the tail and goes on in front.
        ``asker`` is the place of a pair's query among the queries.
        """
        found = [np.zeros((0, 2), np.int64)]
        for lo in range(0, len(query), CHUNK):
            part = np.arange(lo, min(lo + CHUNK, len(query)))
            pairs = _Search(self, query[part], head[part], tail[part], backward).run()
            pairs[:, 0] += lo
            found.append(pairs)
        pairs = np.concatenate(found)
        words = len(self.lengths)
        both = np.unique(pairs[:, 0] * words + pairs[:, 1])  # some edits have the same outcome
        asker, word = both // words, both % words
        return np.stack([query[asker], word], axis=1), asker


def _joined(*states):
    return tuple(np.concatenate(x) for x in zip(*states, strict=True))


def _distinct(q, lo, hi):
    by = np.lexsort((hi, lo, q))
    q, lo, hi = q[by], lo[by], hi[by]
    on = np.ones(len(q), bool)
    on[1:] = (q[1:] != q[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return q[on], lo[on], hi[on]


class _Search:
    """Searches that all begin at the same end of their words.

    Seen from that end (delimiter first) a query is a string; ``at`` counts its
    characters.  ``exact`` of them occur unchanged first, then come those among
    which the edit is, up to ``until``, then the rest and the other delimiter.
    """

    def __init__(self, index: Index, query, head, tail, backward: bool):
        self.index, self.query, self.backward = index, query, backward
        self.length = index.lengths[query]
        self.exact = tail if backward else head
        self.until = self.length - (head if backward else tail)
        self.out = index.left if backward else index.right
        self.back = index.right if backward else index.left

    def letter(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The character ``at`` of queries (the delimiter before and behind them)."""
        begin, length = self.index.starts[self.query[q]], self.length[q]
        return self.index.text[begin + (length - 1 - at if self.backward else at)]

    def run(self) -> np.ndarray:
        n, size = len(self.query), len(self.index.text) + 1
        q = np.arange(n)
        # The exact part from its inner end to the delimiter: towards the word's
        # end that the search begins at, so against the direction it will take.
        lo, hi, other = np.zeros(n, np.int64), np.full(n, size), np.zeros(n, np.int64)
        for step in range(int(self.exact.max(initial=0)) + 1):
            at = self.exact - 1 - step
            on = np.flatnonzero(at >= -1)
            a, b, less = self.back.extend(self.letter(on, at[on]), lo[on], hi[on])
            lo[on], hi[on], other[on] = a, b, other[on] + less
        # Turn round: the same occurrences as an interval of the other direction.
        # ``free`` have had no error yet, ``spent`` have; all are ``step`` further.
        free, spent = (q, other, other + (hi - lo)), (q[:0], lo[:0], hi[:0])
        found, step = [], 0
        while len(free[0]) or len(spent[0]):
            more, swap, drop = self._errors(step, *free)
            spent = self._exactly(step, *_joined(spent, more))
            ended = self.exact[spent[0]] + step == self.length[spent[0]]
            if ended.any():
                found.append(self._words(spent[0][ended], spent[1][ended]))
                spent = tuple(x[~ended] for x in spent)
            spent = _joined(spent, swap, drop)
            if step >= LONG:  # in long runs of one character many edits are the same
                spent = _distinct(*spent)
            on = self.exact[free[0]] + step < self.until[free[0]]
            free = self._exactly(step, *(x[on] for x in free))
            step += 1
        return np.concatenate([np.zeros((0, 2), np.int64), *found])

    def _exactly(self, step: int, q, lo, hi):
        """The states that go on with the next character of their query."""
        a, b, _ = self.out.extend(self.letter(q, self.exact[q] + step), lo, hi)
        on = b > a
        return q[on], a[on], b[on]

    def _errors(self, step: int, q, lo, hi):
        """The states after an error: a character too many, another one, one too few.

        The last two are a character of their query further.
        """
        at = self.exact[q] + step
        # The characters that follow the states: read from small intervals, all for large ones.
        letters, width = self.index.letters, hi - lo
        small = width <= letters
        repeat = np.where(small, width, letters)
        state = np.repeat(np.arange(len(q)), repeat)
        nth = np.arange(len(state)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        letter = np.where(small[state], self.out.before[np.minimum(lo[state] + nth, len(self.out.before) - 1)], nth)
        both = np.unique(state * letters + letter)
        state, letter = both // letters, both % letters
        state, letter = state[letter > 0], letter[letter > 0]
        a, b, _ = self.out.extend(letter, lo[state], hi[state])
        on = b > a
        state, letter, a, b = state[on], letter[on], a[on], b[on]
        inside = at < self.until[q]
        swap = inside[state] & (letter != self.letter(q[state], np.minimum(at, self.length[q])[state]))
        return (q[state], a, b), (q[state[swap]], a[swap], b[swap]), (q[inside], lo[inside], hi[inside])

    def _words(self, q: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The word whose delimiters the interval spans: the words are distinct, so one."""
        place = self.out.places[lo]
        if not self.backward:  # a place in the reversed text: of the delimiter behind the word
            end = len(self.index.text) - 1 - place
            word = np.searchsorted(self.index.starts, end, "right") - 1
        else:
            word = self.index.word_at[place + 1]
        return np.stack([q, word], axis=1)


def common_prefix(index: Index, pairs: np.ndarray) -> np.ndarray:
    """Characters that the two words of a pair share from their starts."""
    one, two = index.starts[pairs[:, 0]], index.starts[pairs[:, 1]]
    short = np.minimum(index.lengths[pairs[:, 0]], index.lengths[pairs[:, 1]])
    shared, on = np.zeros(len(pairs), np.int64), np.arange(len(pairs))
    while len(on):
        on = on[shared[on] < short[on]]
        on = on[index.text[one[on] + shared[on]] == index.text[two[on] + shared[on]]]
        shared[on] += 1
    return shared


