"""The document registry (``doc_info``) as a ledger of processed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registry_count(doc_info: DataFrame) -> DataFrame:
    """One row: the number of registered documents."""
    return doc_info.agg(F.count(F.lit(1)).alias("documents"))


def processed_documents(doc_info: DataFrame) -> DataFrame:
    """Distinct document keys of the registry."""
    return doc_info.select("document").distinct()


def new_documents(corpus: DataFrame, ledger: DataFrame | None, size: int | None = None) -> DataFrame:
    """Documents of ``corpus`` not yet in ``ledger``; at most ``size`` of them.

    A left anti join on ``document`` (AQE broadcasts the ledger only when
    it measures small, else both sides are hash partitioned).  ``size``
    bounds one ingest run: the first ``size`` new documents by key
    (``size=0`` takes none, ``None`` all).  Only keys go through the top-k
    that finds the last key of the run; the texts are filtered by it where
    they are and keep the corpus's partitions.
    """

    def unseen(df: DataFrame) -> DataFrame:
        return df if ledger is None else df.join(ledger.select("document"), "document", "left_anti")

    if size is None:
        return unseen(corpus)
    keys = unseen(corpus.select("document")).orderBy("document").limit(int(size))
    return unseen(corpus.where(F.col("document") <= keys.agg(F.max("document")).scalar()))
