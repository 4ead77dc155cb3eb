"""WARC archives: writing, reading back, and an external index merge.

*Writing.*  Captures with equal payloads (SHA-1 and length) of at least a
given size share one ``response`` record, that of the largest page; the others
become ``revisit`` records that refer to it.  Records are written with Spark's
text sink, whose line separator is the blank line that ends a WARC record, so
archives are gzip-compressed WARC 1.1 files in any store that Spark can reach.

*Reading.*  The text source splits files at blank lines; each task puts the
parts of a record together again by its ``Content-Length`` (payloads may hold
blank lines), one record at a time, and digests the payload it has read.

*Index.*  Each task sorts the index entries of the records it reads into runs
by (URL key, timestamp, page).  The runs are stored, their entries are dealt
out by ranges of that key, and within each range the runs' sorted pieces are
merged k ways by a loser tree into one globally ordered list of captures.  A
URL with very many captures spans several ranges, since the timestamp is
part of the key.

Defined results: a null html is an empty payload; a null URL is written as an
empty target; line ends and other control characters in URLs are percent-
encoded in headers; repeated rows are records each (of rows with one
``page_id`` and payload, all are responses); an empty table gives no records;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored

#: Payloads from this size on are stored once.
LEAST = 1000
BLANK = "\r\n\r\n"
#: Entries of a run; entries that one merge task takes.
RUN = 100_000
RANGE = 100_000

ENTRIES = (
    "url_key string, captured timestamp, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, run long"
)


def captures(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages(page_id, url, html, captured)`` with digest, type and reference."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        "captured",
        html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"),
        F.octet_length(html).cast("long").alias("bytes"),
    )
    same = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(
        F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("copies")
    )
    same = stored(same.where("copies > 1").drop("copies"), f"{scratch(pages.sparkSession)}/holders")
    rows = rows.join(same, ["digest", "bytes"], "left")
    revisit = F.col("holder").isNotNull() & (F.col("holder") != F.col("page_id"))
    return rows.withColumn("refers_to", F.when(revisit, F.col("holder"))).drop("holder")


def _header_safe(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    for code in [*range(33), 127]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def records(rows: DataFrame) -> DataFrame:
    """One WARC record a row, as text without its closing blank line."""
    number = F.col("page_id").cast("string")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(BLANK),
    )
    whole = F.col("refers_to").isNull()
    length = F.octet_length(http) + F.when(whole, F.col("bytes")).otherwise(F.lit(0))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(whole, F.lit("response")).otherwise(F.lit("revisit")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(number, F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        _header_safe(F.col("url")),
        F.lit("\r\nWARC-Date: "),
        F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(whole, F.lit("")).otherwise(
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                F.lit("\r\nWARC-Refers-To: <urn:page:"),
                F.col("refers_to").cast("string"),
                F.lit(">"),
            )
        ),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        length.cast("string"),
        F.lit(BLANK),
    )
    return rows.select(F.concat(head, http, F.when(whole, F.col("html")).otherwise(F.lit(""))).alias("value"))


def write_archives(rows: DataFrame, path: str) -> None:
    """WARC files under ``path``, a file per task."""
    records(rows).write.mode("overwrite").option("lineSep", BLANK).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """SURT form: host labels reversed, then path and query, lower case."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:  # not a URL: its own key
        return url.lower()
    if not host:
        return url.lower()
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return (",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + query).lower()


def read_records(segments: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of (file, segment between blank lines)."""
    blank = BLANK.encode()
    head, block, held, want, of = None, [], 0, 0, None

    def opened(segment: bytes):
        lines = segment.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{of}: no record where one should begin")
        return {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    for file, segment in segments:
        if file != of:
            if head is not None:
                raise ValueError(f"{of} ends inside a record")
            of = file
        if head is None:
            if segment:
                head, block, held = opened(segment), [], -len(blank)
                want = int(head["Content-Length"])
            continue
        block.append(segment)
        held += len(blank) + len(segment)
        if held < want:
            continue
        whole = blank.join(block)
        yield head, whole[:want]
        # A payload that ends with a line end has its end mark found a line
        # early; what follows the mark then begins the next record.
        after, head = whole[want:], None
        if after and not after.startswith(blank):
            raise ValueError(f"{of}: a record is longer than its Content-Length")
        if len(after) > len(blank):
            head, block, held = opened(after[len(blank) :]), [], -len(blank)
            want = int(head["Content-Length"])
    if head is not None:
        raise ValueError(f"{of} ends inside a record")


def _entry(head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(BLANK.encode())
    kind = head["WARC-Type"]
    url = head.get("WARC-Target-URI", "")
    page = re.search(r"urn:page:(-?\d+)", head["WARC-Record-ID"])
    refers = re.search(r"urn:page:(-?\d+)", head.get("WARC-Refers-To", ""))
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if head["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError(f"{head['WARC-Record-ID']}: the payload does not have its digest")
    else:  # the length and digest of the payload it stands for
        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    return (
        url_key(url), np.datetime64(head["WARC-Date"].rstrip("Z"), "us").astype(np.int64).item(),
        int(page[1]) if page else None, url, kind, int(refers[1]) if refers else None, size, digest,
    )


_KINDS = [
    pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.string(), pa.int64(),
    pa.int64(), pa.string(), pa.int64(),
]
_NAMES = [c.split()[0] for c in ENTRIES.split(", ")]


def _order(e: tuple) -> tuple:
    return e[0], e[1], e[2] is not None, e[2] or 0, e[4], e[7]


def _batch(entries: list[tuple]) -> pa.RecordBatch:
    cols = zip(*entries, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], _NAMES)


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries of the records of this task's archives, in sorted runs."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    run, entries = task << 32, []

    def segments():
        for b in batches:
            for file, value in zip(b.column(0), b.column(1), strict=True):
                yield file.as_py(), value.as_py()

    for head, block in read_records(segments()):
        entries.append(_entry(head, block))
        if len(entries) == RUN:
            yield _batch([(*e, run) for e in sorted(entries, key=_order)])
            run, entries = run + 1, []
    if entries:
        yield _batch([(*e, run) for e in sorted(entries, key=_order)])


def loser_tree(runs: list[Iterator], key) -> Iterator:
    """Merge sorted runs: each inner node keeps the loser of its last match,
    so that the next item costs one match per level."""
    k = len(runs)
    heads = [next(r, None) for r in runs]

    def beats(a: int, b: int) -> bool:  # an exhausted run loses to all
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        ka, kb = key(heads[a]), key(heads[b])
        return ka < kb or (ka == kb and a < b)

    losers = [0] * k  # losers[0]: the winner of all
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1] if k > 1 else 0
    while k and heads[top] is not None:
        yield heads[top]
        heads[top] = next(runs[top], None)
        node = (top + k) // 2
        while node:
            if beats(losers[node], top):
                top, losers[node] = losers[node], top
            node //= 2


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range's entries, run after run, merged into one order."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    runs: dict[int, list[tuple]] = {}
    for b in batches:
        for e in zip(*(c.to_pylist() if c.type != _KINDS[1] else c.cast(pa.int64()).to_pylist() for c in b.columns), strict=True):
            runs.setdefault(e[-1], []).append(e)
    out, place = [], 0
    for e in loser_tree([iter(r) for r in runs.values()], _order):
        out.append((*e[:-1], (part << 40) + place))
        place += 1
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The merged index of the archives under ``path``.

    A row per record, ``position`` ascending in order of (URL key, timestamp, page).
    """
    # A gzip file is one split, so its segments reach one task in order.
    lines = spark.read.option("lineSep", BLANK).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    runs = stored(lines.mapInArrow(_sorted_runs, ENTRIES), f"{scratch(spark)}/runs")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page_id")
    dealt = dealt.sortWithinPartitions("run", "url_key", "captured", "page_id", "record_type", "payload_digest")
    return dealt.mapInArrow(_merged, ENTRIES).withColumnRenamed("run", "position")
