"""Documents written as files: one file each, whatever the key, read back as they were."""

import os

from corpusterms.sources import files

KEYS = ["a", "b/c", "50%", "%41", "x=1", "it's", "é café", ".", "..", ".hidden", "_temp", " ", "k[1]{2}^", "a:b?*#\\\"", "l\nm", "9" * 240]


def _bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _files(path):
    return [os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n != "_SUCCESS"]


def test_a_document_is_one_file_and_no_more(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"teks {i}") for i in range(200)], "document long, text string")
    path = tmp_path / "files"
    files.write_document_files(docs, str(path))
    found = _files(path)
    assert len(found) == 200  # no checksums beside them
    folders = {os.path.dirname(f) for f in found}
    assert all(d.startswith(str(path / "folder=")) and os.path.dirname(d) == str(path) for d in folders)  # nor a folder each
    with open(found[0], encoding="utf-8") as f:
        assert f.read().startswith("teks ")
    back = files.read_document_files(spark, str(path))
    assert _bag(back) == sorted(((str(i), f"teks {i}") for i in range(200)), key=repr)


def test_any_key_and_any_text_come_back(spark, tmp_path):
    rows = [(k, f"teks {i}") for i, k in enumerate(KEYS)]
    rows += [("null", None), ("empty", ""), ("lines", "a\n\nb\n"), ("end", "a\r\n"), ("long", "é" * 100_000)]
    docs = spark.createDataFrame(rows, "document string, text string")
    want = sorted(((k, t or "") for k, t in rows), key=repr)
    files.write_document_files(docs, str(tmp_path / "disk"))
    assert _bag(files.read_document_files(spark, str(tmp_path / "disk"))) == want
    files.write_document_files(docs.limit(3), "file://" + str(tmp_path / "disk"))  # what lay there goes
    assert len(_files(tmp_path / "disk")) == 3
    assert _bag(files.read_document_files(spark, "file://" + str(tmp_path / "disk"))) == sorted(rows[:3], key=repr)


def test_rows_of_one_key_share_a_file(spark, tmp_path, monkeypatch):
    rows = [("a", "satu"), ("b", "dua"), ("a", "satu"), ("a", None), (None, "tiga"), (None, None), ("", "empat")]
    docs = spark.createDataFrame(rows, "document string, text string").repartition(5)
    files.write_document_files(docs, str(tmp_path / "disk"))
    disk = files.read_document_files(spark, str(tmp_path / "disk"))
    got = sorted(((k, sorted(t.split("\n"))) for k, t in disk.collect()), key=repr)
    assert got == [("a", ["", "satu", "satu"]), ("b", ["dua"]), (None, ["", "tiga"]), (None, ["empat"])]
    with monkeypatch.context() as m:  # a store that is no mounted disk: Spark's own sink
        m.setattr(files, "_on_disk", lambda *_: None)
        files.write_document_files(docs, str(tmp_path / "store"))
        store = files.read_document_files(spark, str(tmp_path / "store"))
        assert sorted(((k, sorted(t.split("\n"))) for k, t in store.collect()), key=repr) == got
    # What Spark's sink has written on a disk is read like the rest.
    disk = files.read_document_files(spark, str(tmp_path / "store"))
    assert sorted(((k, sorted(t.split("\n"))) for k, t in disk.collect()), key=repr) == got


def test_no_documents(spark, tmp_path):
    files.write_document_files(spark.createDataFrame([], "document long, text string"), str(tmp_path / "files"))
    back = files.read_document_files(spark, str(tmp_path / "files"))
    assert back.columns == ["document", "text"] and back.collect() == []
    assert os.listdir(tmp_path / "files") == ["_SUCCESS"]
