"""Incremental ingest: process unseen documents, remember them.

Store layout (Parquet, one folder per table, partitioned by the writer's
``run_id`` and its ``batch_id``)::

    <store>/term_info/run_id=<r>/batch_id=<n>/       enriched term rows (terms.term_stats)
    <store>/ngram_two/run_id=<r>/batch_id=<n>/       bigram occurrences (the bag, as built)
    <store>/ngram_three/run_id=<r>/batch_id=<n>/     trigram occurrences
    <store>/term_state/run_id=<r>/batch_id=<n>/      the batch's mergeable statistics of each term
    <store>/term_doc_delta/run_id=<r>/batch_id=<n>/  term_doc_info counts of the batch
    <store>/doc_info/run_id=<r>/batch_id=<n>/        the registry
    <store>/commits/<number>.json                    the commit log (``streaming.commits``); written last
    <store>/key_index/<number>/, key_indexes/        indexes of the registry's keys (``index_registry``)

Every writer has a run id of its own (a fresh one per ``ingest_batch`` call; a
stream's is its query id, which lives in its checkpoint), so no writer can
overwrite what another has stored.  A batch anti-joins the registry, computes
every table from one regex pass over the new documents, writes its
partitions with dynamic partition overwrite and then its commit: a batch
counts from the moment it is committed, and every reader here leaves out
batches that are not.  A replayed batch (same run and batch id) leaves its own
rows out of the anti-join and overwrites exactly its own output.  A stream
that has lost its checkpoint starts as a new run, for which all stored
documents are done.  Several writers may run at once: before it writes and
before it commits, a batch compares its documents with those of the batches
committed since it read the registry, and where they share one it is computed
anew without those; what it had written in vain is deleted first.  Writers of
one process that share a document take turns, so none of them writes in vain.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, nullcontext

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions.scores import IDF_SERIES, idf
from ..functions.tokens import word_lane
from ..operators import key_index
from ..operators.markdown import markdown_text
from ..operators.ngrams import ngram_rows
from ..operators.registry import new_documents
from ..operators.terms import term_stats_from_words
from ..schemas import TERM_STATS
from ..session import shared_dir
from ..sources.files import raw_corpus
from ..storage import stored
from . import commits

TABLES = ("term_info", "ngram_two", "ngram_three", "doc_info")
BATCH_KEY = ["run_id", "batch_id"]


def table_path(store: str, name: str) -> str:
    return os.path.join(store, name)


def _batch_path(spark: SparkSession, store: str, name: str, key: tuple[str, int]) -> str:
    """The folder of one batch's partition of a table."""
    run = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(key[0])
    return os.path.join(table_path(store, name), f"run_id={run}", f"batch_id={key[1]}")


def read_table(spark: SparkSession, store: str, name: str, key: tuple[str, int] | None = None) -> DataFrame | None:
    """A stored table as it lies there, or one batch's part; None if nothing was ever committed.

    Any other failure to read (a corrupt file, no permission) is raised: an
    unreadable registry must not pass for an empty one.
    """
    table = table_path(store, name)
    try:
        return spark.read.option("basePath", table).parquet(table if key is None else _batch_path(spark, store, name, key))
    except AnalysisException as e:
        # No folder, or one that holds no committed file (a first write that crashed).
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def registered_batches(
    spark: SparkSession, store: str, after: int = 0, upto: int | None = None
) -> DataFrame | None:
    """The keys of the batches committed (after one commit, up to another)."""
    log = commits.read(spark, store, after, upto)
    return None if log is None else log.select(*BATCH_KEY).distinct()


def stored_table(
    spark: SparkSession, store: str, name: str, after: int = 0, upto: int | None = None
) -> DataFrame | None:
    """The rows of committed batches, with ``run_id`` and ``batch_id``.

    ``upto`` reads the store as it was at that commit (``commits.last``).
    """
    df = read_table(spark, store, name)
    if df is None:
        return None
    done = commits.read(spark, store, after, upto)
    return df.limit(0) if done is None else df.join(done, BATCH_KEY, "left_semi").select(df.columns)


def _of(df: DataFrame, key: tuple[str, int]) -> DataFrame:
    return df.where((F.col("run_id") == key[0]) & (F.col("batch_id") == key[1]))


def registry(
    spark: SparkSession,
    store: str,
    exclude: tuple[str, int] | None = None,
    after: int = 0,
    upto: int | None = None,
) -> DataFrame | None:
    """The document registry, optionally without one batch's partition."""
    reg = stored_table(spark, store, "doc_info", after, upto)
    if reg is not None and exclude is not None:
        reg = reg.where(~((F.col("run_id") == exclude[0]) & (F.col("batch_id") == exclude[1])))
    return reg


def index_registry(spark: SparkSession, store: str, buckets: int | None = None) -> int:
    """Index the keys registered so far; batches that follow read it.

    A batch then reads the index's filter, the buckets it hits and the registry
    of the batches committed since, not every key.  Run it now and then: it
    rewrites the keys alone.  Returns the commit it was made at.
    """
    at = commits.last(spark, store)
    reg = registry(spark, store, upto=at)
    if reg is None:
        return at
    path = table_path(store, f"key_index/{at}-{uuid.uuid4().hex}")
    measures = key_index.build(reg, path, buckets)
    row = spark.createDataFrame([(at, path, *measures.values())], "at long, path string, words long, buckets long, keys long")
    row.coalesce(1).write.mode("append").parquet(table_path(store, "key_indexes"))  # last: from now on it is read
    return at


def ledger_for(
    spark: SparkSession, store: str, corpus: DataFrame, exclude: tuple[str, int] | None = None, upto: int | None = None
) -> DataFrame | None:
    """The registered keys that ``corpus`` may hold: all of them without an index."""
    made = read_table(spark, store, "key_indexes")
    if made is not None and upto is not None:
        made = made.where(F.col("at") <= upto)
    index = None if made is None else made.orderBy(F.desc("at"), "path").first()
    replayed = index and exclude and not _of(commits.read(spark, store, upto=index["at"]), exclude).isEmpty()
    if not index or replayed:  # the index can't leave out a batch it holds
        return registry(spark, store, exclude, upto=upto)
    measures = {m: index[m] for m in ("words", "buckets", "keys")}
    held = key_index.known(corpus.select("document"), index["path"], measures)
    return registry(spark, store, exclude, index["at"], upto).select("document").unionByName(held)


def _commit(spark: SparkSession, store: str, key: tuple[str, int], at: int) -> bool:
    """Commit the batch as written; False if one committed since ``at`` holds one of its documents."""
    own = read_table(spark, store, "doc_info", key)
    while True:
        now = commits.last(spark, store)
        if _taken(spark, store, own, key, at, now):
            return False
        if commits.create(spark, store, now + 1, *key):
            return True
        at = now  # another took the number: look at its documents, then try the next


def _taken(spark: SparkSession, store: str, own: DataFrame, key: tuple[str, int], at: int, now: int) -> bool:
    """Whether a batch committed after ``at``, up to ``now``, holds a document of ``own``."""
    if now <= at:
        return False
    others = registry(spark, store, key, after=at, upto=now).select("document")
    return not own.select("document").join(others, "document", "left_semi").isEmpty()


#: The writers at work in this process, by store: the keys of their documents, and whether they are done.
_at_work: dict[str, list[tuple[DataFrame, threading.Event]]] = {}
_at_work_lock = threading.Lock()


@contextmanager
def _turn(store: str, keys: DataFrame) -> Iterator[None]:
    """Wait until the writers of this process that came before and hold one of ``keys`` are done.

    Only one of them could commit what both wrote.  Those of other documents
    go on beside each other.
    """
    own = (keys, threading.Event())
    with _at_work_lock:
        before = list(_at_work.setdefault(store, []))
        _at_work[store].append(own)
    try:
        for others, done in before:
            if not done.is_set() and not keys.join(others, "document", "left_semi").isEmpty():
                done.wait()
        yield
    finally:
        with _at_work_lock:
            _at_work[store].remove(own)
            if not _at_work[store]:
                del _at_work[store]
        own[1].set()


def _discard(spark: SparkSession, store: str, key: tuple[str, int]) -> None:
    """Delete the large tables' part of a batch that was tried and not committed.

    No reader counts it; it would lie there beside what is written anew, and for
    good where that is empty.  The delta stays: who follows it has heard it.
    """
    for name in ("term_info", "ngram_two", "ngram_three", "term_state"):
        path = spark._jvm.org.apache.hadoop.fs.Path(_batch_path(spark, store, name, key))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _write(df: DataFrame, store: str, name: str) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BATCH_KEY)
    writer = writer.option("compression", "zstd")  # the n-grams of a text take several times its room
    if name in ("ngram_two", "ngram_three"):
        # Hardly an n-gram comes twice in a row group: no dictionary to look them up in.
        writer = writer.option("parquet.enable.dictionary#term", "false")
    writer.parquet(table_path(store, name))


def new_lanes(
    corpus: DataFrame,
    ledger: DataFrame | None = None,
    size: int | None = None,
    dedupe: bool = False,
    markdown: bool = False,
) -> DataFrame:
    """(document, lane) of the documents not in ``ledger``, at most ``size``.

    ``markdown``: texts are markdown; only those of new documents are read.
    """
    new = corpus.select("document", "text")
    if dedupe:
        new = new.dropDuplicates(["document"])
    new = new_documents(new, ledger, size)
    if markdown:
        new = markdown_text(new)
    return new.select("document", word_lane(F.col("text")).alias("lane"))


def lane_tables(lanes: DataFrame) -> dict[str, DataFrame]:
    """Every table of a batch from its (document, lane) rows."""
    words = lanes.select("document", F.array_remove("lane", "").alias("words"))
    ts = term_stats_from_words(words).select(*TERM_STATS.fieldNames())
    return {
        "term_info": ts,
        # The bag (one row per occurrence), as the reference's tables hold
        # it; ``ngrams.count_rows`` groups it on read.
        "ngram_two": ngram_rows(lanes, 2),
        "ngram_three": ngram_rows(lanes, 3),
        "term_doc_delta": term_doc_delta(ts),
        "doc_info": words.select("document", F.size(F.array_distinct("words")).cast("long").alias("term_count")),
    }


def term_doc_delta(ts: DataFrame) -> DataFrame:
    return ts.groupBy(F.col("lower").alias("term")).agg(F.count(F.lit(1)).alias("doc_count"))


def term_state(ts: DataFrame) -> DataFrame:
    """Per lower-cased term what a summary needs, in a form that merges.

    Term rows, documents, documents flagged by this term (they add up to N),
    and greatest, least and sum of the term frequency over a document's words
    (``tf``) and over its distinct terms (``vocab``).
    """
    tf = F.col("occurence") / F.col("token_total").cast("double")
    per = [
        f(x).alias(f"{name}_{part}")
        for name, x in (("tf", tf), ("vocab", F.col("frequency")))
        for part, f in (("max", F.max), ("min", F.min), ("sum", F.sum))
    ]
    return ts.groupBy(F.col("lower").alias("term")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("lower_first").cast("long")).alias("documents"),
        F.sum(F.col("doc_first").cast("long")).alias("flagged"),
        *per,
    )


def merged_states(states: DataFrame) -> DataFrame:
    """The states of several batches as one: one row a term."""
    how = {"max": F.max, "min": F.min}
    numbers = [c for c in states.columns if c not in ("term", *BATCH_KEY)]
    return states.groupBy("term").agg(*[how.get(c.rsplit("_", 1)[-1], F.sum)(c).alias(c) for c in numbers])


def stored_summary(
    spark: SparkSession,
    store: str,
    idf_mode: str = IDF_SERIES,
    tf_mode: str = "tokens",
    df_mode: str = "documents",
    n_mode: str = "terms",
) -> DataFrame | None:
    """``scoring.tf_idf_summary`` of the whole store from the batches' term states.

    Reads a row per batch and term, never the term rows: what a new batch
    costs does not grow with the documents stored.
    """
    states = stored_table(spark, store, "term_state")
    if states is None:
        return None
    both = stored(merged_states(states))
    if n_mode == "terms":
        n = both.agg(F.sum("flagged")).scalar()
    else:
        n = registry(spark, store).agg(F.count(F.lit(1))).scalar()
    name = {"tokens": "tf", "vocab": "vocab"}[tf_mode]
    scored = both.select("*", n.alias("_n"))
    scored = scored.select("*", idf(F.col("_n"), F.col({"documents": "documents", "rows": "rows"}[df_mode]), idf_mode).alias("_idf"))
    i, most, least = F.col("_idf"), F.col(f"{name}_max"), F.col(f"{name}_min")
    return scored.select(
        F.when(i >= 0, i * most).otherwise(i * least).alias("maxtfidf"),
        (i * F.col(f"{name}_sum") / F.col("rows")).alias("meantfidf"),
        F.when(i >= 0, i * least).otherwise(i * most).alias("mintfidf"),
        F.col("term").alias("lower"),
    ).orderBy(F.desc("maxtfidf"), "lower")


def batch_tables(
    corpus: DataFrame, ledger: DataFrame | None = None, size: int | None = None, dedupe: bool = False
) -> dict[str, DataFrame]:
    """What one batch adds to each table: a function of corpus and ledger alone."""
    return lane_tables(new_lanes(corpus, ledger, size, dedupe))


def ingest_batch(
    spark: SparkSession,
    corpus: DataFrame,
    store: str,
    size: int | None = None,
    run_id: str | None = None,
    batch_id: int = 0,
    dedupe: bool = False,
    markdown: bool = False,
) -> tuple[str, int]:
    """Ingest the documents of ``corpus`` not yet registered in ``store``.

    ``size`` bounds the run to the first ``size`` new documents by key (0
    does nothing).  ``dedupe`` keeps one row per document key (needed when
    files of the same name come from several folders); ``markdown``: the texts
    are markdown.  Returns the batch's key ``(run_id, batch_id)``: pass it again to replay the batch.
    """
    given = run_id is not None
    run_id = run_id or f"batch-{uuid.uuid4().hex}"
    key = (run_id, int(batch_id))
    if size == 0:
        return key
    at = commits.last(spark, store)
    # A replay of a committed batch writes what lies there; one that was never
    # committed, or lost to another writer, may now have other documents.
    committed = given and at > 0 and not _of(commits.read(spark, store), key).isEmpty()
    tried = given and not committed
    lost = False
    while True:
        ledger = ledger_for(spark, store, corpus, key, at)
        keys = new_documents(corpus.select("document"), ledger, size)
        if lost and not tried and keys.isEmpty():  # the keys alone tell, no text is read
            return key
        with nullcontext() if committed else _turn(store, keys):
            now = commits.last(spark, store)
            lost = not committed and _taken(spark, store, keys, key, at, now)
            if not lost:
                lanes = new_lanes(corpus, ledger, size, dedupe, markdown)
                written = _write_batch(spark, lanes, store, key, tried)
                if not written or committed or _commit(spark, store, key, at):
                    return key
                lost, tried, now = True, True, commits.last(spark, store)
        at = now


def _write_batch(spark: SparkSession, lanes: DataFrame, store: str, key: tuple[str, int], tried: bool) -> bool:
    """Write every table of a batch; False (and nothing counts) without documents."""
    if tried:
        _discard(spark, store, key)
    # One regex pass per document, reused by every table of the batch.  The
    # cache only saves work: what an executor loses is computed anew.  It holds
    # a lane as one string (words hold no spaces), about as long as the text: an
    # array's slots take several times that.
    kept = lanes.select("document", F.array_join("lane", " ").alias("lane")).persist(StorageLevel.MEMORY_AND_DISK)
    lanes = kept.select("document", F.split("lane", " ").alias("lane"))
    try:
        mark = [F.lit(key[0]).alias("run_id"), F.lit(key[1]).cast("int").alias("batch_id")]
        if kept.isEmpty():  # nothing new: leave every table as it is
            if tried:
                _write(_delta(spark, store, key, None).select("*", *mark), store, "term_doc_delta")
            return False
        tables = {name: df.select("*", *mark) for name, df in lane_tables(lanes).items()}
        # Sorted by lower inside each file: row-group statistics then prune
        # word look-ups (``lower = ?``) on the stored table.
        tables["term_info"] = tables["term_info"].sortWithinPartitions("lower")
        # Independent tables: submitted as concurrent jobs, so the tail of
        # one job overlaps the others on the cluster.
        with ThreadPoolExecutor(max_workers=3) as pool:
            for f in [pool.submit(_write, tables[n], store, n) for n in ("term_info", "ngram_two", "ngram_three")]:
                f.result()
        # The terms' states from the partition just written, and from those the
        # term_doc_info delta, so both are maintained incrementally.
        # (A store whose documents have no terms yet has no file of either.)
        infos = read_table(spark, store, "term_info", key)
        state = term_state(tables["term_info"] if infos is None else infos)
        _write(state.select("*", *mark), store, "term_state")
        states = read_table(spark, store, "term_state", key)
        delta = (state if states is None else states).select("term", F.col("rows").alias("doc_count"))
        if tried:
            delta = _delta(spark, store, key, delta)
        _write(delta.select("*", *mark), store, "term_doc_delta")
        _write(tables["doc_info"], store, "doc_info")
    finally:
        kept.unpersist()
    return True


def _delta(spark: SparkSession, store: str, key: tuple[str, int], delta: DataFrame | None) -> DataFrame:
    """``delta``, with 0 for each term that an earlier try of the batch counted and it does not.

    Who follows the deltas as they arrive then takes back what that try said.
    """
    empty = spark.createDataFrame([], "term string, doc_count long")
    delta = empty if delta is None else delta
    old = read_table(spark, store, "term_doc_delta", key)
    if old is None:
        return delta
    old = stored(old.select("term"))  # written: its files are about to be replaced
    return delta.unionByName(old.join(delta, "term", "left_anti").select("term", F.lit(0).cast("long").alias("doc_count")))


def ingest_stream(
    spark: SparkSession,
    source_dir: str,
    store: str,
    checkpoint: str | None = None,
    max_files_per_trigger: int | None = None,
    markdown: bool = True,
    available_now: bool = True,
    processing_time: str = "1 minute",
) -> StreamingQuery:
    """Watch ``source_dir`` for document files and ingest them per micro-batch.

    Each new file is one document (whole-text file source, key = file
    name); ``foreachBatch`` runs ``ingest_batch`` with the query's id as the
    run id and the epoch as the batch id.  The checkpoint lives under the
    session's ``spark.checkpoint.dir`` unless ``checkpoint`` is given; without
    either this raises (a local folder would forget the offsets).
    """
    reader = spark.readStream.format("text").option("wholetext", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    corpus = raw_corpus(reader.load(source_dir))

    def run(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        # Kept in the checkpoint: the same after a restart, another without it.
        query = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        ingest_batch(session, batch, store, run_id=f"stream-{query}", batch_id=int(epoch_id), dedupe=True, markdown=markdown)

    if checkpoint is None:
        tag = hashlib.sha1(f"{source_dir}->{store}".encode()).hexdigest()[:12]
        checkpoint = os.path.join(shared_dir(spark), f"ingest-{tag}")
    w = corpus.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def term_doc_info_stream(spark: SparkSession, store: str) -> DataFrame:
    """Streaming ``term_doc_info``: rows per lower-cased term, kept up to date.

    Reads the batches' deltas as they arrive (run it in ``update`` output mode:
    a row is a term's new count).  The state of a term is the sum of its
    settled counts and, for each run, the last batch and its count: a batch
    that follows settles the one before, the file that a replay writes anew
    replaces the count it repeats.  So the state does not grow with the
    batches of a run.
    """
    delta = read_table(spark, store, "term_doc_delta")
    schema = (
        delta.schema
        if delta is not None
        else StructType(
            [
                StructField("term", StringType()),
                StructField("doc_count", LongType()),
                StructField("run_id", StringType()),
                StructField("batch_id", IntegerType()),
            ]
        )
    )
    rows = spark.readStream.schema(schema).parquet(table_path(store, "term_doc_delta"))
    return rows.groupBy("term").applyInPandasWithState(
        _settle, "term string, doc_count long", TERM_COUNTS, "update", GroupStateTimeout.NoTimeout
    )


#: A term's settled count; per run its last batch and that batch's count.
TERM_COUNTS = "settled long, runs array<string>, batches array<int>, counts array<long>"


def _settle(key: tuple, frames: Iterator, state) -> Iterator:
    import pandas as pd

    settled, runs, batches, counts = state.get if state.exists else (0, [], [], [])
    last = {r: (int(b), int(c)) for r, b, c in zip(runs, batches, counts, strict=True)}
    # A run's batches in order; of one batch written twice the later file holds the same.
    for r in pd.concat(list(frames)).sort_values(["run_id", "batch_id"]).itertuples():
        batch, count = last.get(r.run_id, (-1, 0))
        if r.batch_id > batch:
            settled += count
        if r.batch_id >= batch:  # an older one is a replay of what is settled
            last[r.run_id] = (int(r.batch_id), int(r.doc_count))
    names = list(last)
    state.update((int(settled), names, [last[r][0] for r in names], [last[r][1] for r in names]))
    yield pd.DataFrame({"term": [key[0]], "doc_count": [settled + sum(c for _, c in last.values())]})


def stored_term_doc_info(spark: SparkSession, store: str) -> DataFrame | None:
    """``term_doc_info`` of the whole store: the registered batches' deltas summed."""
    delta = stored_table(spark, store, "term_doc_delta")
    if delta is None:
        return None
    return delta.groupBy("term").agg(F.sum("doc_count").cast("long").alias("doc_count")).where("doc_count > 0")


def stored_tables(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """The store's tables: rows of registered batches, without batch columns."""
    out = {}
    for name in TABLES:
        df = stored_table(spark, store, name)
        if df is not None:
            out[name] = df.drop(*BATCH_KEY)
    return out


def compact(spark: SparkSession, store: str, out: str) -> tuple[str, int]:
    """Write the registered rows of ``store`` to a new store ``out`` as one batch.

    Many small batches become few large files: the term table in ranges of
    ``lower`` (a word look-up opens the file or two that hold the word, not
    every file), the registry in ranges of ``document``, the deltas summed.
    """
    key = (f"compact-{uuid.uuid4().hex}", 0)
    mark = [F.lit(key[0]).alias("run_id"), F.lit(key[1]).cast("int").alias("batch_id")]
    tables = stored_tables(spark, store)
    tables["term_doc_delta"] = stored_term_doc_info(spark, store)
    states = stored_table(spark, store, "term_state")
    tables["term_state"] = None if states is None else merged_states(states)
    order = {"term_info": ["lower", "document", "term"], "doc_info": ["document"]}
    order |= {"term_doc_delta": ["term"], "term_state": ["term"]}
    for name in ("term_info", "ngram_two", "ngram_three", "term_state", "term_doc_delta", "doc_info"):
        by = order.get(name, ["lower1", "document"])
        if tables.get(name) is not None:
            ranged = tables[name].repartitionByRange(*by).sortWithinPartitions(*by)
            _write(ranged.select("*", *mark), out, name)
    commits.create(spark, out, commits.last(spark, out) + 1, *key)
    return key
