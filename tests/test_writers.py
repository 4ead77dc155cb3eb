"""What writers that meet compute and leave: no stale rows, no files of a batch that lost, nothing twice."""

import glob
import threading
from contextlib import nullcontext

import pyarrow.parquet as pq

from corpusterms.operators import terms
from corpusterms.streaming import commits, ingest

from .test_commits import meet, run_all
from .test_ingest import DOCS, _everything_once

LARGE = ("term_info", "ngram_two", "ngram_three", "term_state")


def _files(store, name):
    return glob.glob(f"{store}/{name}/run_id=*/batch_id=*/*.parquet")


def _meanwhile(monkeypatch, call):
    """``call`` runs behind what the first batch writes, before its commit: as another process's writer would."""
    write, once = ingest._write_batch, []

    def writing(*a):
        written = write(*a)
        if not once:
            once.append(1)
            call()
        return written

    monkeypatch.setattr(ingest, "_write_batch", writing)
    monkeypatch.setattr(ingest, "_turn", lambda *_: nullcontext(), raising=False)


def test_a_batch_left_without_terms_keeps_none_of_what_it_lost(spark, corpus, tmp_path, monkeypatch):
    store, c = str(tmp_path / "s"), corpus(("a", "Saluang ialah alat muzik"), ("b", "... !"), ("c", None))
    _meanwhile(monkeypatch, lambda: ingest.ingest_batch(spark, c.where("document = 'a'"), store))
    ingest.ingest_batch(spark, c, store)
    tables = ingest.stored_tables(spark, store)
    assert commits.last(spark, store) == 2
    assert sorted(map(tuple, tables["doc_info"].collect())) == [("a", 4), ("b", 0), ("c", 0)]
    want = sorted(map(tuple, terms.term_info(c).collect()))
    assert sorted(map(tuple, terms.term_info(tables["term_info"]).collect())) == want  # a's once
    assert tables["ngram_two"].count() == 3 and tables["ngram_three"].count() == 2


def test_a_batch_that_lost_everything_leaves_no_files(spark, corpus, tmp_path, monkeypatch):
    store, c = str(tmp_path / "s"), corpus(*DOCS)
    _meanwhile(monkeypatch, lambda: ingest.ingest_batch(spark, c, store))
    ingest.ingest_batch(spark, c, store)
    _everything_once(spark, store, [n for n, _ in DOCS])
    assert commits.last(spark, store) == 1
    for name in LARGE:
        assert len({f.split("/run_id=")[1].split("/")[0] for f in _files(store, name)}) == 1
    want = sorted(map(tuple, terms.term_doc_info(c).collect()))
    assert sorted(map(tuple, ingest.stored_term_doc_info(spark, store).collect())) == want


def test_writers_of_the_same_documents_compute_them_once(spark, corpus, tmp_path, monkeypatch):
    store, c = str(tmp_path / "s"), corpus(*DOCS)
    write, written = ingest._write_batch, []

    def writing(spark, lanes, *a):
        written.extend(r.document for r in lanes.select("document").collect())
        return write(spark, lanes, *a)

    monkeypatch.setattr(ingest, "_write_batch", writing)
    meet(monkeypatch, 3)
    parts = [c, c.where("document = 'b.md'"), c.where("document > 'b'")]
    run_all(*[lambda d=d: ingest.ingest_batch(spark, d, store) for d in parts])
    _everything_once(spark, store, [n for n, _ in DOCS])
    assert sorted(written) == sorted(n for n, _ in DOCS)
    assert not ingest._at_work


def test_writers_of_other_documents_do_not_wait(spark, corpus, tmp_path, monkeypatch):
    store, c = str(tmp_path / "s"), corpus(*DOCS)
    write, both = ingest._write_batch, threading.Barrier(2)

    def writing(*a):
        both.wait(120)  # neither gets on before the other is here
        return write(*a)

    monkeypatch.setattr(ingest, "_write_batch", writing)
    run_all(*[lambda d=d: ingest.ingest_batch(spark, c.where(d), store) for d in ("document < 'c'", "document >= 'c'")])
    _everything_once(spark, store, [n for n, _ in DOCS])


def test_a_writer_that_fails_lets_the_next_one_go_on(spark, corpus, tmp_path, monkeypatch):
    store, c = str(tmp_path / "s"), corpus(*DOCS)
    write, failed = ingest._write_batch, []

    def writing(*a):
        if not failed:
            failed.append(1)
            raise RuntimeError("disk full")
        return write(*a)

    def tried():
        try:
            ingest.ingest_batch(spark, c, store)
        except RuntimeError:
            pass

    monkeypatch.setattr(ingest, "_write_batch", writing)
    meet(monkeypatch, 2)
    run_all(tried, tried)
    _everything_once(spark, store, [n for n, _ in DOCS])
    assert failed and not ingest._at_work


def test_stored_tables_are_packed_by_zstd(spark, corpus, tmp_path):
    store = str(tmp_path / "s")
    ingest.ingest_batch(spark, corpus(*DOCS), store)
    for name in (*LARGE, "term_doc_delta", "doc_info"):
        assert _files(store, name)
        for f in _files(store, name):
            group = pq.ParquetFile(f).metadata.row_group(0)
            assert {group.column(i).compression for i in range(group.num_columns)} == {"ZSTD"}
