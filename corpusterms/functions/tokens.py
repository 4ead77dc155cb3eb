"""Token grammar as Column expressions.

The whole tokenizer is one ``regexp_extract_all`` per document: it stays in
the JVM (whole-stage codegen), needs no Python worker and no shuffle.  The
grammar is an ordered choice, tried at each position:

1. a wiki-table run: ``{|`` followed by any letters, digits, ASCII white
   space and punctuation (one punctuation token);
2. a hyphen compound: two ASCII alphanumeric runs joined by one ``-``;
3. an ASCII alphanumeric run;
4. white space (dropped);
5. one punctuation character;
6. any other single character ("omit").

Java regex and RE2 both take the leftmost alternative first, so the same
pattern string runs in Spark and in DuckDB (the test oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference grammar) -----------------------
# Punctuation characters, in the reference's order:
PUNCT_CHARS = ".,;:–/()\"[]'*|=-{}’%!"
# Opening of a wiki table, swallowed with what follows into one token:
TABLE_OPEN = "{|"
# Unicode White_Space code points (tokens made only of these are dropped):
# U+0009..U+000D, U+0020, U+0085, U+00A0, U+1680, U+2000..U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000
WHITE_SPACE_CLASS = (
    r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}"
)
# ---------------------------------------------------------------------------

KIND_TEXT = "text"
KIND_PUNCT = "punct"
KIND_OMIT = "omit"


def _class_escape(chars: str) -> str:
    """Escape characters for use inside a regex character class."""
    return "".join("\\" + c if c in "[]\\-^" else c for c in chars)


PUNCT_CLASS = _class_escape(PUNCT_CHARS)
ALNUM = "A-Za-z0-9"
_TABLE = r"\{\|[" + ALNUM + r" \t\r\n" + PUNCT_CLASS + "]*"
_WORD = "[" + ALNUM + "]+(?:-[" + ALNUM + "]+)?"
_SKIP_WS = "[" + WHITE_SPACE_CLASS + "]*"
_OTHER = "[^" + WHITE_SPACE_CLASS + "]"

# Group 1 = one non-white-space token, in grammar order.  White space is
# skipped in front of each token, which is the same as emitting and then
# dropping it (it never changes where the next token starts).
TOKEN_RE = _SKIP_WS + "(" + _TABLE + "|" + _WORD + "|" + _OTHER + ")"

# Group 1 = the token if it is a word token, else '' (Spark) / NULL (RE2).
# The array keeps one slot per token, so non-word tokens still break n-grams.
WORD_LANE_RE = _SKIP_WS + "(?:" + _TABLE + "|(" + _WORD + ")|" + _OTHER + ")"

# A word token in a text without a wiki table (Spark; \p{Alnum} is ASCII, and looked up in a table).
PLAIN_WORD_RE = r"\p{Alnum}+(?:-\p{Alnum}+)?"

# A word token starts with an ASCII letter or digit.
WORD_START_RE = "^[" + ALNUM + "]"
PUNCT_START_RE = "^[" + PUNCT_CLASS + "]"
# A hyphen compound ("kata ganda"): exactly two alphanumeric runs.
COMPOUND_RE = "^[" + ALNUM + "]+-[" + ALNUM + "]+$"


def token_array(text: Column) -> Column:
    """All non-white-space tokens of ``text``, in order (array<string>)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_RE), F.lit(1))


def word_lane(text: Column) -> Column:
    """One slot per token: the word for word tokens, '' for the others."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_LANE_RE), F.lit(1))


def word_array(text: Column) -> Column:
    """Word tokens only, in order (punctuation and omitted chars removed).

    Without a wiki-table opening every other token is one character that is
    no letter or digit, so the words are found by themselves.
    """
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(PLAIN_WORD_RE), F.lit(0))
    return F.when(t.contains(TABLE_OPEN), F.array_remove(word_lane(t), "")).otherwise(words)


def token_kind(token: Column) -> Column:
    """Classify a token by its first character: punct, text or omit."""
    return (
        F.when(token.rlike(PUNCT_START_RE), F.lit(KIND_PUNCT))
        .when(token.rlike(WORD_START_RE), F.lit(KIND_TEXT))
        .otherwise(F.lit(KIND_OMIT))
    )


def is_compound(term: Column) -> Column:
    return term.rlike(COMPOUND_RE)


def has_words(text: Column) -> Column:
    """True when ``text`` holds at least one word token.

    Exact and cheap: without a wiki-table opening every ASCII letter or
    digit belongs to a word token, so a scan that stops at the first one
    decides; only texts holding ``{|`` are tokenized.
    """
    t = F.coalesce(text, F.lit(""))
    return F.when(t.contains(TABLE_OPEN), F.size(word_array(t)) > 0).otherwise(t.rlike("[" + ALNUM + "]"))
