"""Incremental ingest: batches, reruns, replays and the streaming path."""

import pytest
from pyspark.sql import functions as F

from corpusterms.operators import ngrams, scoring, terms
from corpusterms.streaming import ingest

DOCS = [
    ("a.md", "Saluang saluang, alat muzik. Saluang"),
    ("b.md", "alat muzik tiup kayu"),
    ("c.md", "…"),
    ("d.md", "Teknik ini dinamakan juga sebagai teknik"),
    ("e.md", "kira-kira 40–60 cm, dengan diameter 3–4 cm"),
]


def snapshot(spark, store):
    t = ingest.stored_tables(spark, store)
    ti = sorted(tuple(r) for r in t["term_info"].select("document", "term", "lower", "occurence").collect())
    di = sorted(tuple(r) for r in t["doc_info"].select("document", "term_count").collect())
    ng = sorted(tuple(r) for r in t["ngram_two"].select("document", "term", "occurence").collect())
    return ti, di, ng


def updates(counts, checkpoint):
    """What a running count says of each term it changes, and the query."""
    seen = {}

    def take(batch, _):
        seen.update({r.term: r.doc_count for r in batch.collect()})

    q = counts.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(checkpoint))
    q = q.trigger(availableNow=True).start()
    q.awaitTermination(300)
    return seen, q


def test_batches_equal_one_batch(spark, corpus, tmp_path):
    c = corpus(*DOCS)
    one = str(tmp_path / "one")
    ingest.ingest_batch(spark, c, one)
    many = str(tmp_path / "many")
    ingest.ingest_batch(spark, c, many, size=2)
    ingest.ingest_batch(spark, c, many, size=2)
    ingest.ingest_batch(spark, c, many, size=2)
    assert snapshot(spark, one) == snapshot(spark, many)
    ti, di, _ = snapshot(spark, one)
    want = sorted(tuple(r) for r in terms.term_info(c).select("document", "term", "lower", "occurence").collect())
    assert ti == want
    assert ("c.md", 0) in di and len(di) == 5
    assert ingest.registered_batches(spark, many).count() == 3


def test_rerun_is_noop_and_replay_overwrites(spark, corpus, tmp_path):
    c = corpus(*DOCS)
    store = str(tmp_path / "s")
    run, batch = ingest.ingest_batch(spark, c, store, size=3)
    before = snapshot(spark, store)
    ingest.ingest_batch(spark, c.where("document <= 'c.md'"), store)  # nothing new
    assert snapshot(spark, store) == before
    # Replaying the batch (as after a failure) leaves each document once.
    assert ingest.ingest_batch(spark, c, store, size=3, run_id=run, batch_id=batch) == (run, batch)
    assert snapshot(spark, store) == before
    ingest.ingest_batch(spark, c, store, size=0)
    assert snapshot(spark, store) == before


def test_ngram_tables(spark, corpus, tmp_path):
    c = corpus(*DOCS)
    store = str(tmp_path / "s")
    ingest.ingest_batch(spark, c, store)
    _, _, ng = snapshot(spark, store)
    want = sorted(tuple(r) for r in ngrams.ngram_rows(c, 2).select("document", "term", "occurence").collect())
    assert ng == want
    stored = ingest.stored_tables(spark, store)["ngram_three"]
    got = sorted(tuple(r) for r in ngrams.count_rows(stored).select("document", "term", "occurence").collect())
    want = sorted(tuple(r) for r in ngrams.ngram_counts(c, 3).select("document", "term", "occurence").collect())
    assert got == want


def test_stream_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name, text in DOCS:
        (src / name).write_text(text, encoding="utf-8")
    store = str(tmp_path / "store")
    q = ingest.ingest_stream(spark, str(src), store, checkpoint=str(tmp_path / "ckpt"), max_files_per_trigger=2)
    q.awaitTermination(300)
    ti, di, _ = snapshot(spark, store)
    assert len(di) == 5
    assert ingest.registered_batches(spark, store).count() == 3
    # A new file later: only it is processed by the next run.
    (src / "f.md").write_text("Saluang baru", encoding="utf-8")
    q = ingest.ingest_stream(spark, str(src), store, checkpoint=str(tmp_path / "ckpt"), max_files_per_trigger=2)
    q.awaitTermination(300)
    _, di2, _ = snapshot(spark, store)
    assert len(di2) == 6 and ("f.md", 2) in di2

    agg = ingest.term_doc_info_stream(spark, store)
    got = updates(agg, tmp_path / "ck2")[0]
    assert got["saluang"] == 3  # a.md: Saluang + saluang; f.md: Saluang


def test_term_doc_info_maintained_per_batch(spark, corpus, tmp_path):
    c = corpus(*DOCS)
    store = str(tmp_path / "s")
    ingest.ingest_batch(spark, c, store, size=2)
    run, batch = ingest.ingest_batch(spark, c, store, size=2)

    def streamed():
        return updates(ingest.term_doc_info_stream(spark, store), tmp_path / "ck")[0]

    first = streamed()
    assert first["saluang"] == 2
    ingest.ingest_batch(spark, c, store, size=2, run_id=run, batch_id=batch)  # replay
    ingest.ingest_batch(spark, c, store)
    got = sorted(tuple(r) for r in ingest.stored_term_doc_info(spark, store).collect())
    want = sorted(tuple(r) for r in terms.term_doc_info(c).collect())
    assert got == want
    # The stream has seen the replayed batch's file twice: counted once.
    assert first | streamed() == dict(want)


def test_running_counts_have_a_state_that_batches_do_not_grow(spark, corpus, tmp_path):
    store, c = str(tmp_path / "s"), corpus(*DOCS)
    held, rows = {}, []
    for batch in range(4):
        ingest.ingest_batch(spark, c, store, size=1, run_id="r", batch_id=batch)
        if batch == 2:  # replayed before and after the stream has seen it
            ingest.ingest_batch(spark, c, store, size=1, run_id="r", batch_id=batch)
        got, query = updates(ingest.term_doc_info_stream(spark, store), tmp_path / "ck")
        held |= got
        states = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
        rows += [(max(states), len(held))] if states else []
    assert len(rows) > 2 and all(a == b for a, b in rows)
    assert held == {r.term: r.doc_count for r in ingest.stored_term_doc_info(spark, store).collect()}


def test_a_run_settles_its_batches_in_order():
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state = State()

    def add(*rows):
        frame = pd.DataFrame(rows, columns=["run_id", "batch_id", "doc_count"])
        return next(iter(ingest._settle(("t",), [frame], state))).doc_count[0]

    assert add(("r", 0, 5)) == 5
    assert add(("r", 1, 2), ("q", 0, 1)) == 8
    assert add(("r", 1, 2)) == 8  # replayed: replaced
    assert add(("r", 0, 5)) == 8  # settled long ago
    assert add(*[("r", i, 1) for i in range(2, 500)]) == 506
    assert sorted(state.get[1]) == ["q", "r"]


def test_the_stores_summary_comes_from_the_terms_states(spark, corpus, tmp_path):
    store, c = str(tmp_path / "s"), corpus(*DOCS)
    for _ in range(3):
        ingest.ingest_batch(spark, c, store, size=2)
    ingest.ingest_batch(spark, c, store)
    columns = ["maxtfidf", "meantfidf", "mintfidf"]

    def rounded(df):
        return sorted((r.lower, *[None if r[x] is None else round(r[x], 9) for x in columns]) for r in df.collect())

    for modes in ({}, {"idf_mode": "log10", "tf_mode": "vocab", "df_mode": "rows", "n_mode": "registry"}, {"idf_mode": "ratio"}):
        whole = rounded(scoring.tf_idf_summary(c, **modes))
        assert rounded(ingest.stored_summary(spark, store, **modes)) == whole
    plan = ingest.stored_summary(spark, store)
    assert not any("/term_info/" in f for f in plan.inputFiles())
    compacted = str(tmp_path / "compacted")
    ingest.compact(spark, store, compacted)
    assert rounded(ingest.stored_summary(spark, compacted)) == rounded(scoring.tf_idf_summary(c))
    assert ingest.stored_summary(spark, str(tmp_path / "none")) is None


def _write_docs(folder, docs):
    folder.mkdir(exist_ok=True)
    for name, text in docs:
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def _everything_once(spark, store, names):
    t = ingest.stored_tables(spark, store)
    assert sorted(r.document for r in t["doc_info"].collect()) == sorted(names)
    texts = dict(DOCS)
    c = spark.createDataFrame([(n, texts[n]) for n in names], "document string, text string")
    want = sorted(tuple(r) for r in terms.term_info(c).select("document", "term", "occurence").collect())
    assert sorted(tuple(r) for r in t["term_info"].select("document", "term", "occurence").collect()) == want


def _stream(spark, src, store, checkpoint):
    ingest.ingest_stream(spark, src, store, checkpoint=str(checkpoint)).awaitTermination(300)


def test_batch_and_streams_share_a_store(spark, corpus, tmp_path):
    store = str(tmp_path / "s")
    ingest.ingest_batch(spark, corpus(*DOCS[:2]), store)
    _stream(spark, _write_docs(tmp_path / "one", DOCS[2:3]), store, tmp_path / "ck1")
    _everything_once(spark, store, ["a.md", "b.md", "c.md"])
    _stream(spark, _write_docs(tmp_path / "two", DOCS[3:]), store, tmp_path / "ck2")
    _everything_once(spark, store, [n for n, _ in DOCS])


def test_a_lost_checkpoint_loses_nothing(spark, tmp_path):
    store, src = str(tmp_path / "s"), _write_docs(tmp_path / "in", DOCS[:3])
    _stream(spark, src, store, tmp_path / "ck1")
    _write_docs(tmp_path / "in", DOCS[3:])
    _stream(spark, src, store, tmp_path / "ck-new")
    _everything_once(spark, store, [n for n, _ in DOCS])


def test_a_crashed_batch_is_not_read_and_can_be_replayed(spark, corpus, tmp_path, monkeypatch):
    c, store = corpus(*DOCS), str(tmp_path / "s")
    ingest.ingest_batch(spark, c.where("document < 'c'"), store)
    write = ingest._write

    def crash(df, where, name):
        if name == "doc_info":
            raise RuntimeError("executor gone")
        write(df, where, name)

    monkeypatch.setattr(ingest, "_write", crash)
    with pytest.raises(RuntimeError):
        ingest.ingest_batch(spark, c, store, run_id="r", batch_id=4)
    monkeypatch.setattr(ingest, "_write", write)
    _everything_once(spark, store, ["a.md", "b.md"])
    assert ingest.stored_term_doc_info(spark, store).count() == 5
    ingest.ingest_batch(spark, c, store, run_id="r", batch_id=4)
    _everything_once(spark, store, [n for n, _ in DOCS])


def test_an_unreadable_registry_is_an_error(spark, corpus, tmp_path):
    store = tmp_path / "s"
    ingest.ingest_batch(spark, corpus(*DOCS), str(store))
    for f in (store / "doc_info").rglob("*.parquet"):
        f.write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        ingest.ingest_batch(spark, corpus(*DOCS), str(store))


def test_stream_wants_a_shared_checkpoint(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from corpusterms.session import shared_dir

    nothing = SimpleNamespace(get=lambda *a: None)
    bare = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))
    monkeypatch.setattr(ingest, "shared_dir", lambda _: shared_dir(bare))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ingest.ingest_stream(spark, _write_docs(tmp_path / "in", DOCS[:1]), str(tmp_path / "s"))


def test_compacted_store_reads_the_same(spark, corpus, tmp_path):
    c, store, out = corpus(*DOCS), str(tmp_path / "s"), str(tmp_path / "c")
    for _ in range(3):
        ingest.ingest_batch(spark, c, store, size=2)
    ingest.compact(spark, store, out)
    assert snapshot(spark, out) == snapshot(spark, store)
    assert ingest.registered_batches(spark, out).count() == 1
    same = [sorted(tuple(r) for r in ingest.stored_term_doc_info(spark, s).collect()) for s in (store, out)]
    assert same[0] == same[1]
    ingest.ingest_batch(spark, c, out)  # nothing new
    assert ingest.registered_batches(spark, out).count() == 1


def test_bounded_batch_keeps_texts_out_of_the_limit(spark, corpus):
    c = corpus(*[(f"{i:03d}", f"teks {i}") for i in range(40)]).repartition(6)
    new = ingest.new_lanes(c, None, size=30)
    assert new.count() == 30
    # Only keys pass the top-k; the lanes come from the corpus's own partitions.
    plan = new._jdf.queryExecution().executedPlan().toString()
    top = [line for line in plan.splitlines() if "TakeOrderedAndProject" in line]
    assert top and not any("text" in line or "lane" in line for line in top), plan
    assert new.rdd.getNumPartitions() == 6


def test_pure_tables_equal_stored_ones(spark, corpus, tmp_path):
    c, store = corpus(*DOCS), str(tmp_path / "s")
    ledger = spark.createDataFrame([("b.md",)], "document string")
    pure = ingest.batch_tables(c, ledger, size=2)
    ingest.ingest_batch(spark, c.where("document in ('a.md', 'c.md')"), store)
    for name, df in ingest.stored_tables(spark, store).items():
        assert sorted(map(tuple, pure[name].collect())) == sorted(map(tuple, df.select(pure[name].columns).collect()))
