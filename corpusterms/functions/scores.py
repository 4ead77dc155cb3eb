"""Scalar scoring expressions (IDF variants, edge rounding)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDF_LOG10 = "log10"  # log10(N / (1 + df)), the one-word ranking formula
IDF_RATIO = "ratio"  # N / df, "10 to the idf", unlogged
IDF_SERIES = "series"  # 2 (x + x^3/3 + x^5/5 + x^7/7) with x = N / df
IDF_MODES = (IDF_LOG10, IDF_RATIO, IDF_SERIES)


def idf(n_docs: Column, df: Column, mode: str = IDF_SERIES) -> Column:
    """Inverse document frequency of a term seen in ``df`` of ``n_docs``.

    Division goes through ``try_divide`` so a zero denominator gives NULL
    (as SQLite does) instead of an ANSI error.
    """
    n = n_docs.cast("double")
    d = df.cast("double")
    if mode == IDF_LOG10:
        return F.log10(F.try_divide(n, F.lit(1.0) + d))
    x = F.try_divide(n, d)
    if mode == IDF_RATIO:
        return x
    if mode == IDF_SERIES:
        # Written as repeated products, term by term, so that every engine
        # rounds the same way the SQL recipe does.
        return F.lit(2) * (
            (x / F.lit(1))
            + (x * x * x / F.lit(3))
            + (x * x * x * x * x / F.lit(5))
            + (x * x * x * x * x * x * x / F.lit(7))
        )
    raise ValueError(f"idf mode must be one of {IDF_MODES}, got {mode!r}")


def round_sig(c: Column, digits: int = 9) -> Column:
    """Round a double to ``digits`` significant digits (presentation only).

    Goes through the decimal text of the number, which both Spark and the
    SQL oracle produce and parse back exactly, so scores that differ only in
    the last bits of a floating sum compare equal.
    """
    return F.when(c.isNotNull(), F.format_string(f"%.{digits - 1}e", c).cast("double"))


def format_score(c: Column, places: int = 5) -> Column:
    """A score as fixed-point text with ``places`` decimals (``0.12346``)."""
    return F.format_string(f"%.{places}f", c)
