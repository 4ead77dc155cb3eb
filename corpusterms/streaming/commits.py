"""The commit log of a store: which batches count, in which order.

``<store>/commits/<number>.json`` is one manifest (``commit``, ``run_id``,
``batch_id``).  Numbers have no gaps and a manifest is created only where none
lies yet, complete or not at all: by a hard link on a local disk, elsewhere by a
rename that refuses to replace (atomic on HDFS).  Of two writers that want the
same number one gets it; the other looks at what was committed meanwhile and
takes the next.  A reader that goes by the manifests up to a number sees the
store as it was then, whatever is written after it.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "commit long, run_id string, batch_id int"


def _folder(spark: SparkSession, store: str):
    """The log's Hadoop path and file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/commits")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def last(spark: SparkSession, store: str) -> int:
    """The number of the last commit; 0 in a store without one (a listing, no job)."""
    path, fs = _folder(spark, store)
    if not fs.exists(path):
        return 0
    names = (f.getPath().getName() for f in fs.listStatus(path))
    return max((int(n[:-5]) for n in names if n[0] not in "._" and n.endswith(".json")), default=0)


def read(spark: SparkSession, store: str, after: int = 0, upto: int | None = None) -> DataFrame | None:
    """The manifests numbered from ``after`` (not included) to ``upto``; None without a log."""
    try:
        log = spark.read.schema(MANIFEST).json(f"{store}/commits")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    log = log.where(F.col("commit") > after)
    return log if upto is None else log.where(F.col("commit") <= upto)


def create(spark: SparkSession, store: str, number: int, run_id: str, batch_id: int) -> bool:
    """Write manifest ``number``; False, with nothing changed, if there is one."""
    path, fs = _folder(spark, store)
    line = json.dumps({"commit": number, "run_id": run_id, "batch_id": batch_id}) + "\n"
    name, draft = f"{number:012d}.json", f".{uuid.uuid4().hex}.tmp"
    if fs.getScheme() == "file":
        folder = path.toUri().getPath()
        os.makedirs(folder, exist_ok=True)
        draft = os.path.join(folder, draft)
        with open(draft, "w", encoding="utf-8") as f:
            f.write(line)
        try:
            os.link(draft, os.path.join(folder, name))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(path, draft), hadoop.Path(path, name)
    out = fs.create(source, False)
    out.write(bytearray(line, "utf-8"))
    out.close()
    # ``rename`` returns False, or raises, where the target lies already.
    try:
        if not fs.exists(target) and fs.rename(source, target):
            return True
    except Exception:
        if not fs.exists(target):
            raise
    fs.delete(source, False)
    return False
