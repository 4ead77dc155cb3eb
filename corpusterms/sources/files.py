"""Folders of documents (one file = one document, keyed by file name)."""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.markdown import markdown_text
from ..session import bounded_batches

#: Folders that documents written as files are dealt to.
FOLDERS = 1024
#: Documents, and bytes of them, that a reading task hands on at once.
ROWS, BYTES = 1000, 8 << 20
#: A document's file is named by its key as Spark names a partition's folder.
NAME = b"document="
NO_KEY = b"__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(rb"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]")


def read_documents(spark: SparkSession, path: str, markdown: bool = True) -> DataFrame:
    """Corpus ``(document, text)`` from the files directly in ``path``.

    Whole-file text source (``wholetext``): each file is one row, files are
    spread over tasks by Spark's file splitting; the key is the file name
    (``_metadata.file_name``).  With ``markdown`` the text is cleaned by
    ``markdown_text``.  For millions of small files set
    ``spark.sql.files.openCostInBytes`` / ``maxPartitionBytes`` so a task
    packs many files, or compact them to Parquet once.
    """

    corpus = raw_corpus(spark.read.text(path, wholetext=True))
    return markdown_text(corpus) if markdown else corpus


def raw_corpus(raw: DataFrame) -> DataFrame:
    """``(document, text)`` of a whole-file text source."""
    return raw.select(F.col("_metadata.file_name").alias("document"), F.col("value").alias("text"))


def write_documents(docs: DataFrame, path: str, text_col: str = "text") -> None:
    """Write a corpus as Parquet (the compact form of a document folder)."""
    docs.select("document", text_col).write.mode("overwrite").parquet(path)


def write_document_files(docs: DataFrame, path: str) -> None:
    """A file per document: ``<path>/folder=<n>/document=<key>`` (one line end is added).

    Documents are dealt by folder (``FOLDERS`` of them, by a hash of the key), so
    the rows of one key meet in one task, which writes them to one file, a line
    end behind each.  On a disk that is mounted as a folder a task opens its
    files itself, in a folder of its attempt; the commit moves whole folders of
    the attempts that ended, and what lay there before goes.  (Hadoop's local
    file system makes checksum files and starts processes for what it makes.)
    In any other store it is Spark's own partitioned text sink:
    ``<path>/folder=<n>/document=<key>/part-*.txt``.
    """
    key = F.col("document").cast("string")
    folder = F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int").alias("folder")
    rows = docs.select(folder, key.alias("document"), F.coalesce("text", F.lit("")).alias("value"))
    disk = _on_disk(docs.sparkSession, path)
    if disk is None:
        rows.repartition("folder").write.mode("overwrite").partitionBy("folder", "document").text(path)
        return
    bounded_batches(docs.sparkSession)
    # As bytes: a text is written as it is, valid UTF-8 or not.  Until the files
    # are written the shuffled texts lie on the disk as well: they are packed.
    rows = rows.select("folder", F.col("document").cast("binary"), F.concat("value", F.lit("\n")).cast("binary").alias("value"))
    rows = rows.mapInArrow(_pack, "folder int, document binary, value binary").repartition("folder")
    attempts = f"{disk}/_temporary-{uuid.uuid4().hex}"
    os.makedirs(attempts)
    try:
        # A row a folder, at most FOLDERS.
        written = rows.mapInArrow(_write_files(attempts), "attempt string, folder int").collect()
        for old in os.scandir(disk):
            if old.path != attempts:
                shutil.rmtree(old.path) if old.is_dir(follow_symlinks=False) else os.unlink(old.path)
        for r in written:
            os.rename(f"{attempts}/{r.attempt}/folder={r.folder}", f"{disk}/folder={r.folder}")
    finally:
        shutil.rmtree(attempts)
    with open(f"{disk}/_SUCCESS", "wb"):
        pass


def _on_disk(spark: SparkSession, path: str) -> str | None:
    """``path`` as the operating system names it, if it lies on a mounted disk."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(at).toUri().getPath() if fs.getScheme() == "file" else None


def _file_name(key: bytes | None) -> bytes:
    return NAME + (_ESCAPED.sub(lambda m: b"%%%02X" % ord(m[0]), key) if key else NO_KEY)


def _file_key(name: bytes) -> bytes | None:
    key = name.removeprefix(NAME)
    return None if key == NO_KEY else unquote_to_bytes(key)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = pa.array((zlib.compress(v, 1) for v in batch.column(2).to_pylist()), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["folder", "document", "value"])


def _write_files(attempts: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, at = uuid.uuid4().hex, {}
        for batch in batches:
            for folder, key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if folder not in at:
                    at[folder] = os.fsencode(f"{attempts}/{attempt}/folder={folder}/")
                    os.makedirs(at[folder])
                with open(at[folder] + _file_name(key), "ab") as f:
                    f.write(zlib.decompress(value))
        yield pa.RecordBatch.from_pydict({"attempt": pa.array([attempt] * len(at), pa.string()), "folder": pa.array(at, pa.int32())})

    return write


def read_document_files(spark: SparkSession, path: str, markdown: bool = False) -> DataFrame:
    """Corpus ``(document, text)`` of a folder that ``write_document_files`` wrote.

    On a disk that is mounted as a folder, tasks list and read the files of some
    folders each: the driver lists the folders alone.  In any other store Spark
    lists the files (in a job of its own from
    ``spark.sql.sources.parallelPartitionDiscovery.threshold`` folders on) and
    deals them to tasks by size, each counted with
    ``spark.sql.files.openCostInBytes`` more.
    """
    disk = _on_disk(spark, path)
    if disk is None or not os.path.isdir(disk):
        fields = [StructField("value", StringType()), StructField("folder", IntegerType()), StructField("document", StringType())]
        raw = spark.read.schema(StructType(fields)).text(path, wholetext=True)
    else:
        folders = sorted(e.path for e in os.scandir(disk) if e.name.startswith("folder="))
        # Folders hold about as much each: so many tasks that a slow one doesn't matter.
        tasks = max(1, min(len(folders), 16 * spark.sparkContext.defaultParallelism))
        raw = spark.range(0, len(folders), 1, tasks).mapInArrow(_read_files(folders), "document binary, value binary")
        raw = raw.select(F.col("document").cast("string"), F.col("value").cast("string"))
    text = F.regexp_replace("value", r"\r?\n\z", "")
    corpus = raw.select("document", text.alias("text"))
    return markdown_text(corpus) if markdown else corpus


def _files_in(folder: str) -> Iterator[tuple[bytes | None, bytes]]:
    """Key and path of each document's file (or files: Spark's sink makes a folder of a key)."""
    for e in os.scandir(os.fsencode(folder)):
        if e.name.startswith(NAME):
            files = [e] if e.is_file() else [f for f in os.scandir(e.path) if f.name[:1] not in (b"_", b".")]
            yield from ((_file_key(e.name), f.path) for f in files)


def _read_files(folders: list[str]) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0

        def held_rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"document": pa.array(keys, pa.binary()), "value": pa.array(values, pa.binary())})

        for batch in batches:
            for i in batch.column(0).to_pylist():
                for key, file in _files_in(folders[i]):
                    with open(file, "rb") as f:
                        values.append(f.read())
                    keys.append(key)
                    held += len(values[-1])
                    if len(keys) >= ROWS or held >= BYTES:
                        yield held_rows()
                        keys, values, held = [], [], 0
        yield held_rows()

    return read
