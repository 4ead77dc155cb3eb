import hashlib
import heapq
import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusterms.llm import warc

PAYLOADS = [
    "a\r\n", "a\r\n\r\n", "\r\n\r\n", "\r\n", "\n", "\r", "x\r\n\r", "", None, "é" * 600, "é" * 600, "z" * 2000 + "\r\n",
    "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "z" * 2000 + "\r\n", "y" * 999, "y" * 999, "q" * 100_000,
]


def test_archives_round_trip(spark, tmp_path):
    rows = [(i * 2, None if i == 3 else f"http://www.A.b:80/{i % 4}\n x?b&a", h, "extra") for i, h in enumerate(PAYLOADS)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    df = df.withColumn("captured", F.timestamp_seconds(F.lit(1000) - F.col("page_id")))
    warc.write_archives(warc.captures(df.repartition(3)), f"{tmp_path}/a")
    got = {r.page_id: r for r in warc.read_index(spark, f"{tmp_path}/a").collect()}
    assert len(got) == len(rows)
    last = {h: i for i, _, h, _ in rows}
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and last[h] != i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", last[h]) if revisit else ("response", None))
    order = [(r.url_key, r.captured, r.page_id) for r in sorted(got.values(), key=lambda r: r.position)]
    assert order == sorted(order)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string, captured timestamp")
    warc.write_archives(warc.captures(df), f"{tmp_path}/e")
    assert warc.read_index(spark, f"{tmp_path}/e").collect() == []


@given(st.lists(st.lists(st.integers(0, 9)), max_size=7))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    merged = list(warc.loser_tree([iter(r) for r in runs], lambda x: x))
    assert merged == list(heapq.merge(*runs))


def test_many_runs():
    rnd = random.Random(1)
    runs = [sorted(rnd.random() for _ in range(rnd.randrange(30))) for _ in range(61)]
    assert list(warc.loser_tree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("http://www.Example.com/A?b=2&a=1#x") == "com,example)/a?a=1&b=2"
    assert warc.url_key("https://a.b:8080") == "b,a:8080)/"
    assert warc.url_key("http://[bad") == "http://[bad" and warc.url_key("") == ""


def test_query_by_definition(spark):
    from corpusterms.llm.queries import QUERIES

    from .conftest import SF

    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op9_warc"](spark, SF).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in got} == {
        p: (len(h), hashlib.sha1(h).hexdigest()) for p, h in pages.items()
    }
