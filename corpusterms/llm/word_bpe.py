"""Ids of a word-level BPE by the ``tokenizers`` library, one cached run at a time.

Vocabularies of this kind lower the case, drop white space and part what is
left into words by a pattern; a token, a composed character or an added token
never reaches across ASCII white space.  So the ids of a run between white
space are its own, and are kept by run.  In a new run of Latin-1 letters,
digits and ASCII signs the words are found here, by the same pattern, and each
new word goes to the library's BPE model once.  A run with any other character
goes to the library whole, and so does a text that may hold an added token, or
every text of a file with other rules.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np

from .common import worker_cache

#: Runs and words that a worker learns before it forgets those not met since
#: the last time; the longest one kept.
KEPT, LONGEST = 500_000, 48
#: Bytes of a text that are split at once.
SLICE = 1 << 20

# --- fixed values (the file's rules that the patterns below stand for) --------
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# -----------------------------------------------------------------------------

_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
# In UTF-8: a Latin-1 letter beyond ASCII; a character that is known here.
_LETTER = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
_KNOWN = rb"(?:[^\x80-\xff \t-\r]|" + _LETTER + rb")"
#: A run with another character, whole; else the words by the split pattern.
_WORD = re.compile(
    rb"(?<![^ \t-\r])" + _KNOWN + rb"*+[\x80-\xff][^ \t-\r]*+"
    rb"|'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|" + _LETTER + rb")+|[0-9]|[^a-z0-9\x80-\xff \t-\r]+"
)
_SIMPLE = re.compile(_KNOWN + rb"*+")
_ASCII_WORD = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9 \t-\r]+")


def _spelled() -> str:
    """The characters that byte-level vocabularies write bytes as, by byte.

    The printable Latin-1 ones are written as themselves, the others as the
    characters from U+0100 on, in order.
    """
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    hidden = iter(range(256))
    return "".join(chr(b) if b in shown else chr(256 + next(hidden)) for b in range(256))


class _Known(dict):
    """Ids by run or word; one that is missing is learnt as it is looked up.

    It holds ``KEPT`` of them at most, and as many from before (``before``):
    what is in use comes back from there, the rest is forgotten.  Those of
    more than ``LONGEST`` bytes are held only until the next text (``long``).
    """

    def __init__(self, learn: Callable[[bytes], bytes]):
        self.learn, self.before, self.long = learn, {}, {}

    def __missing__(self, run: bytes) -> bytes:
        if len(run) > LONGEST:
            found = self.long.get(run)
            if found is None:
                found = self.long[run] = self.learn(run)
            return found
        found = self.before.get(run)
        if found is None:
            found = self.learn(run)
        if len(self) >= KEPT:
            self.before = self.copy()
            self.clear()
        self[run] = found
        return found


class Words:
    """The ids of the words of texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker a core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.spelled = _spelled()
        with open(path, "rb") as f:  # installed on every worker, like the library
            spec = json.load(f)
        splits = [p.get("pattern", {}).get("Regex") for p in spec["pre_tokenizer"].get("pretokenizers", ())]
        self.ruled = spec["normalizer"].get("normalizers") == NORMALIZERS and splits == [SPLIT, None]
        self.added = [t["content"].encode().lower() for t in spec.get("added_tokens", ())]
        self.known = _Known(self._run)

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, run: bytes) -> bytes:
        """The ids of a run without ASCII white space, in lower case there."""
        if run.isalpha():  # of ASCII letters: a word
            return self._tokens(run.decode())
        some = (_ASCII_WORD if run.isascii() else _WORD).findall(run)
        return self._learnt(run) if len(some) == 1 else b"".join(map(self.known.__getitem__, some))

    def _learnt(self, word: bytes) -> bytes:
        if not word.isascii():
            if not _SIMPLE.fullmatch(word):
                return self._whole(word)
            word = word.decode().lower().encode()
        written = word.decode("latin-1")
        if not (word.isascii() and written.isprintable()):  # those are spelled as they are
            written = written.translate(self.spelled)
        return self._tokens(written)

    def _tokens(self, written: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(written)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: bytes) -> np.ndarray:
        """The ids of a text (or of a part of one between white space)."""
        lowered = text.lower()
        if not self.ruled or any(a in lowered for a in self.added):
            return np.frombuffer(self._whole(text), "<u4")
        found = b"".join(map(self.known.__getitem__, lowered.split()))
        self.known.long.clear()
        return np.frombuffer(found, "<u4")


def words(path: str) -> Words:
    """The word table of a vocabulary file, kept by the worker."""
    cache = worker_cache()
    key = ("word_bpe", path)
    if key not in cache:
        cache[key] = Words(path)
    return cache[key]


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """``text`` cut at white space, ``size`` bytes or more each but the last."""
    at = 0
    while len(text) - at > size:
        cut = _SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def encode(table: Words, text: bytes) -> np.ndarray:
    """The ids of a whole text in UTF-8."""
    found = [table.ids(part) for part in slices(text)]
    return found[0] if len(found) == 1 else np.concatenate(found)
