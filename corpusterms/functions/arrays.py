"""In-row array helpers.

A document is one row, so anything counted *within* a document can be
counted inside that row: sort the array, then take run lengths.  That turns
the per-document ``GROUP BY (document, term)`` into a narrow projection, so
term and n-gram tables are built without any shuffle, and memory per task is
bounded by the largest document, not by the number of distinct keys in a
partition.

Each stage is a separate projection whose arrays are referenced more than
once by the next stage, so Catalyst keeps them as materialised columns;
lambdas then read them by position (O(1)), never re-evaluate them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def int_range(n: Column) -> Column:
    """0..n-1 as array<int>; empty when n = 0 (``sequence(0, -1)`` counts down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def sorted_runs(df: DataFrame, src: str, keep: list[str], key=None) -> DataFrame:
    """Sort array ``src`` and find its runs of equal elements.

    Adds ``_s`` (the sorted array), ``_e`` (0-based index of the last
    element of each run, ascending) and ``_n`` (array size).  ``key`` maps
    an element to the part that decides equality (default: the element),
    for struct elements whose first fields are functions of a later one.
    """
    key = key or (lambda e: e)
    s = F.col("_s")
    n = F.size(s)
    staged = df.select(*keep, F.sort_array(F.col(src)).alias("_s"))
    ends = F.filter(
        int_range(n), lambda i: (i == n - 1) | (key(F.get(s, i)) != key(F.get(s, i + 1)))
    )
    return staged.select(*keep, s, n.alias("_n"), ends.alias("_e"))


def run_struct(runs: DataFrame, keep: list[str], build) -> DataFrame:
    """Map each run to a struct: ``build(value, count, prev_value)``.

    ``prev_value`` is the value of the previous run (NULL for the first).
    Adds ``_m`` (number of runs) and ``_r`` (array of the built structs).
    """
    s, e = F.col("_s"), F.col("_e")

    def one(end, j):
        start = F.coalesce(F.get(e, j - 1), F.lit(-1))
        return build(F.get(s, end), end - start, F.get(s, start))

    return runs.select(*keep, "_n", F.size(e).alias("_m"), F.transform(e, one).alias("_r"))


def with_value_counts(df: DataFrame, src: str, out: str, keep: list[str]) -> DataFrame:
    """Add ``out`` = sorted distinct elements of array ``src`` with counts.

    ``out`` is ``array<struct<value: T, count: int>>`` in ascending order of
    value.  ``keep`` lists the columns carried through; ``src`` is dropped.
    Columns ``_n`` (array size) and ``_m`` (distinct count) are added.
    """
    runs = sorted_runs(df, src, keep)
    counted = run_struct(
        runs, keep, lambda v, c, _prev: F.struct(v.alias("value"), c.alias("count"))
    )
    return counted.withColumnRenamed("_r", out)
