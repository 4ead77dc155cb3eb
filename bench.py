"""Benchmark the headline queries.

Runs each query over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints ONE JSON line:

    {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is materialised through the ``noop`` sink (every row computed,
nothing collected), warm (after one untimed warm-up run), median of
"""

from __future__ import annotations

import itertools
import json
import os
import re
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def _materialise(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "5"))
    from corpusterms.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="bench")

    from pyspark.sql import functions as F

    from corpusterms.functions import markup
    from corpusterms.operators import markdown, ngrams, scoring, terms, tokens
    from corpusterms.plans import catalog
    from corpusterms.sources import tables
    from corpusterms.storage import scratch as new_folder
    from corpusterms.streaming import ingest

    # The test tables have one row group each, so one task would read them:
    # deal them out (an explicit choice; registered queries don't).
    tasks = int(cpus) if cpus.isdigit() else spark.sparkContext.defaultParallelism

    def docs():
        return tables.documents_corpus(spark, base, partitions=tasks)

    def dressed(dress):
        d = tables.table(spark, base, "documents").repartition(tasks)
        raw = dress(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text"))
        return d.select(F.col("doc_id").alias("document"), raw.alias("raw"))

    scratch = new_folder(spark)
    stored = os.path.join(scratch, "term_info")
    # A stored enriched term table, for the queries that read Parquet.
    terms.term_stats(docs()).sortWithinPartitions("lower").write.mode("overwrite").parquet(stored)

    stores = itertools.count()

    def store():
        return os.path.join(scratch, f"store-{next(stores)}")

    def ingest_all():
        path = store()
        ingest.ingest_batch(spark, docs(), path)
        return path

    def ingest_bounded():
        ingest.ingest_batch(spark, docs(), store(), size=2000)

    full = ingest_all()
    batches = store()
    for i in range(8):
        ingest.ingest_batch(spark, docs().where(F.pmod(F.col("document"), F.lit(8)) == i), batches)
    compacted = store()
    ingest.compact(spark, batches, compacted)

    def look_up(path):
        t = ingest.stored_tables(spark, path)
        return _materialise(scoring.rank_word(t["term_info"], "the", registry=t["doc_info"]))

    def text(frame, clean):
        return _materialise(frame.select("document", clean(F.col("raw")).alias("text")))

    pages = tables.pages_corpus(spark, base, partitions=tasks).withColumnRenamed("text", "raw")
    q = {
        "tokens": lambda: _materialise(tokens.tokens(docs())),
        "term_info": lambda: _materialise(terms.term_info(docs())),
        "ngram_counts_2": lambda: _materialise(ngrams.ngram_counts(docs(), 2)),
        "ngram_counts_3": lambda: _materialise(ngrams.ngram_counts(docs(), 3)),
        "tf_idf_summary": lambda: _materialise(scoring.tf_idf_summary(docs())),
        "tf_idf_summary_stored": lambda: _materialise(scoring.tf_idf_summary(spark.read.parquet(stored))),
        "tf_idf": lambda: _materialise(scoring.tf_idf(docs())),
        "rank_word_stored": lambda: _materialise(
            scoring.rank_word(spark.read.parquet(stored), "the", registry=terms.doc_info(docs()))
        ),
        "ingest_batch_all": ingest_all,
        "ingest_batch_none_new": lambda: ingest.ingest_batch(spark, docs(), full),
    }
    # Beyond the headline list of the baseline (not in the total).
    more = {
        "ingest_batch_bounded": ingest_bounded,
        "rank_word_8_batches": lambda: look_up(batches),
        "rank_word_compacted": lambda: look_up(compacted),
        "ngram_rows_window_2": lambda: _materialise(ngrams.ngram_rows_from_tokens(tokens.tokens(docs()), 2)),
        "markdown_text": lambda: _materialise(
            markdown.markdown_text(dressed(catalog.markdown_document).withColumnRenamed("raw", "text"))
        ),
        "wikitext_clean": lambda: text(dressed(catalog.wiki_document), markup.wikitext_clean),
        "page_text": lambda: text(pages, markup.html_text),
    }
    times: dict[str, float] = {}
    for name, fn in (q | more).items():
        fn()  # warm-up
        runs = []
        for _ in range(repeat if name in q else 1):
            t = time.perf_counter()
            fn()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs), 3)
        spark.catalog.clearCache()  # nothing cached leaks into the next query

    m = re.search(r"sf([0-9.]+)", base)
    out = {
        "metric": "total_sec",
        "value": round(sum(times[n] for n in q), 3),
        "unit": "sec",
        "queries": {n: times[n] for n in q},
        "more": {n: times[n] for n in more},
        "sf": float(m.group(1)) if m else base,
        "cpus": cpus,
        "repeat": repeat,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
