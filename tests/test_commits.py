"""The commit log, writers at the same moment, and the index of registered keys."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest

from corpusterms.operators import key_index, terms
from corpusterms.streaming import commits, ingest

from .test_ingest import DOCS, _everything_once, snapshot, updates


def run_all(*calls):
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(c) for c in calls]]


def test_a_number_is_taken_once(spark, tmp_path):
    store = str(tmp_path / "s")
    assert commits.last(spark, store) == 0 and commits.read(spark, store) is None
    won = run_all(*[lambda i=i: commits.create(spark, store, 1, f"run{i}", i) for i in range(8)])
    assert sum(won) == 1 and commits.last(spark, store) == 1
    assert [tuple(r) for r in commits.read(spark, store).collect()] == [(1, f"run{won.index(True)}", won.index(True))]


def test_a_number_is_taken_once_by_renames(spark, tmp_path, monkeypatch):
    folder = commits._folder

    class Elsewhere:
        def __init__(self, fs):
            self.fs = fs

        def getScheme(self):
            return "hdfs"

        def __getattr__(self, name):
            return getattr(self.fs, name)

    def remote(spark, store):
        path, fs = folder(spark, store)
        return path, Elsewhere(fs)

    monkeypatch.setattr(commits, "_folder", remote)
    store = str(tmp_path / "s")
    assert commits.create(spark, store, 1, "a", 0) and not commits.create(spark, store, 1, "b", 0)
    assert commits.create(spark, store, 2, "b", 0) and commits.last(spark, store) == 2
    assert [tuple(r) for r in commits.read(spark, store).orderBy("commit").collect()] == [(1, "a", 0), (2, "b", 0)]
    assert [tuple(r) for r in commits.read(spark, store, after=1).collect()] == [(2, "b", 0)]


def meet(monkeypatch, parties):
    """Make the first ``parties`` batches read the registry before any of them commits."""
    barrier, ledger_for, seen = threading.Barrier(parties), ingest.ledger_for, set()

    def waiting(spark, store, corpus, exclude=None, upto=None):
        ledger = ledger_for(spark, store, corpus, exclude, upto)
        if exclude not in seen:
            seen.add(exclude)
            barrier.wait(120)
        return ledger

    monkeypatch.setattr(ingest, "ledger_for", waiting)


@pytest.mark.parametrize("first", ["none", "some"])
def test_two_writers_keep_each_document_once(spark, corpus, tmp_path, monkeypatch, first):
    store, c = str(tmp_path / "s"), corpus(*DOCS)
    if first == "some":
        ingest.ingest_batch(spark, c.where("document = 'c.md'"), store)
    meet(monkeypatch, 2)
    run_all(
        lambda: ingest.ingest_batch(spark, c.where("document < 'd'"), store),
        lambda: ingest.ingest_batch(spark, c.where("document > 'b'"), store),
    )
    _everything_once(spark, store, [n for n, _ in DOCS])
    want = sorted(map(tuple, terms.term_doc_info(c).collect()))
    assert sorted(map(tuple, ingest.stored_term_doc_info(spark, store).collect())) == want
    # Who follows the deltas is told what the writer that lost takes back.
    assert {t: n for t, n in updates(ingest.term_doc_info_stream(spark, store), tmp_path / "ck")[0].items() if n} == dict(want)


def test_a_writer_that_loses_everything_commits_nothing(spark, corpus, tmp_path, monkeypatch):
    store, c = str(tmp_path / "s"), corpus(*DOCS)
    meet(monkeypatch, 2)
    run_all(*[lambda: ingest.ingest_batch(spark, c, store)] * 2)
    _everything_once(spark, store, [n for n, _ in DOCS])
    assert commits.last(spark, store) == 1 == ingest.registered_batches(spark, store).count()


def test_writers_of_other_documents_both_commit_at_once(spark, corpus, tmp_path, monkeypatch):
    store, c = str(tmp_path / "s"), corpus(*DOCS)
    meet(monkeypatch, 3)
    write, written = ingest._write_batch, []
    monkeypatch.setattr(ingest, "_write_batch", lambda *a: written.append(a[3]) or write(*a))
    run_all(*[lambda d=d: ingest.ingest_batch(spark, c.where(f"document = '{d}'"), store) for d in ("a.md", "b.md", "d.md")])
    _everything_once(spark, store, ["a.md", "b.md", "d.md"])
    assert commits.last(spark, store) == 3 and len(written) == 3  # none was computed twice


def test_a_reader_sees_the_store_as_it_was(spark, corpus, tmp_path):
    store, c = str(tmp_path / "s"), corpus(*DOCS)
    ingest.ingest_batch(spark, c, store, size=2)
    at = commits.last(spark, store)
    before = sorted(map(tuple, ingest.stored_table(spark, store, "term_info").collect()))
    ingest.ingest_batch(spark, c, store)
    assert sorted(map(tuple, ingest.stored_table(spark, store, "term_info", upto=at).collect())) == before
    assert ingest.stored_table(spark, store, "doc_info").count() == 5


def test_a_batch_that_crashed_before_its_commit_takes_its_counts_back(spark, corpus, tmp_path, monkeypatch):
    store, c = str(tmp_path / "s"), corpus(*DOCS)

    def crash(*_):
        raise RuntimeError("driver gone")

    with monkeypatch.context() as m:
        m.setattr(ingest, "_commit", crash)
        with pytest.raises(RuntimeError):
            ingest.ingest_batch(spark, c, store, run_id="r", batch_id=0)
    held = updates(ingest.term_doc_info_stream(spark, store), tmp_path / "ck")[0]
    assert held["saluang"] == 2  # said by the batch that never counted
    ingest.ingest_batch(spark, c.where("document = 'a.md'"), store)
    ingest.ingest_batch(spark, c, store, run_id="r", batch_id=0)
    _everything_once(spark, store, [n for n, _ in DOCS])
    held |= updates(ingest.term_doc_info_stream(spark, store), tmp_path / "ck")[0]
    assert {t: n for t, n in held.items() if n} == {r.term: r.doc_count for r in ingest.stored_term_doc_info(spark, store).collect()}


def opened(df):
    """The files that rows of ``df`` come from."""
    return {r[0] for r in df.selectExpr("input_file_name()").distinct().collect()}


def test_the_index_misses_no_key_and_opens_few_buckets(spark, tmp_path):
    path = str(tmp_path / "keys")
    keys = spark.range(20_000).selectExpr("concat('doc-', id) AS document")
    made = key_index.build(keys.unionByName(keys.where("document < 'doc-2'")).repartition(7), path)
    assert made == {"words": 10_000, "buckets": 64, "keys": 20_000}
    assert len(list((tmp_path / "keys" / "keys").glob("bucket=*/*.parquet"))) == 64
    new = spark.range(1_000).selectExpr("concat('new-', id) AS document")
    assert len(key_index.hit_buckets(new, path, made)) <= 5  # by mistake
    some = new.unionByName(keys.where("document IN ('doc-7', 'doc-19999')"))
    held = key_index.known(some, path, made)
    assert len(opened(held)) <= 7
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan, plan
    assert {r.document for r in some.join(held, "document", "left_semi").collect()} == {"doc-7", "doc-19999"}
    assert key_index.indexed_new_documents(some, path, made).count() == 1_000
    assert key_index.indexed_new_documents(keys, path, made).count() == 0


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_an_index_of_null_repeated_or_no_keys(spark, tmp_path, kind):
    keys = spark.createDataFrame([("1",), ("1",), (None,), ("-7",)], "document string").selectExpr(f"CAST(document AS {kind}) AS document")
    corpus = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "c"), ("-7", None)], "document string, bucket string")
    corpus = corpus.selectExpr(f"CAST(document AS {kind}) AS document", "bucket")
    for name, rows, want in (("some", keys, {"b", "c"}), ("none", keys.limit(0), {"a", "b", "c", None})):
        path = str(tmp_path / name)
        got = key_index.indexed_new_documents(corpus, path, key_index.build(rows, path))
        assert got.columns == ["document", "bucket"] and {r.bucket for r in got.collect()} == want


def test_batches_go_by_the_index(spark, corpus, tmp_path):
    store, c = str(tmp_path / "s"), corpus(*DOCS)
    run, batch = ingest.ingest_batch(spark, c, store, size=2)
    assert ingest.index_registry(spark, store) == 1
    ingest.ingest_batch(spark, c.where("document <= 'c.md'"), store)  # behind the index
    before = snapshot(spark, store)
    ledger = ingest.ledger_for(spark, store, c.where("document = 'e.md'"), None, commits.last(spark, store))
    assert {r.document for r in ledger.collect()} == {"c.md"}  # none of the indexed keys is read
    ingest.ingest_batch(spark, c.where("document <= 'c.md'"), store)  # nothing new
    ingest.ingest_batch(spark, c, store, size=2, run_id=run, batch_id=batch)  # a replay of what is indexed
    assert snapshot(spark, store) == before
    ingest.index_registry(spark, store)
    ingest.ingest_batch(spark, c, store)
    _everything_once(spark, store, [n for n, _ in DOCS])
    assert commits.last(spark, store) == 3
