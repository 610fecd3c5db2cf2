"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where all run on one machine, a folder of our own if it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local") or sc.master.startswith("local-cluster") and named is None:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracelake-"))
    return sc.getCheckpointDir()


#: Spark's setting that drops a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writers = threading.Lock(), {}


@contextmanager
def _dropping_shuffles(spark: SparkSession):
    """The setting on for as long as any thread of the session writes; the last one puts back what was."""
    key = id(spark._jsparkSession)
    with _lock:
        count, before = _writers.get(key, (0, None))
        if not count:
            before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writers[key] = (count + 1, before)
    try:
        yield
    finally:
        with _lock:
            count, before = _writers.pop(key)
            if count > 1:
                _writers[key] = (count - 1, before)
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, tag: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder (in folders ``by`` columns) and read again: cuts its lineage, survives lost executors.

    The shuffle files of the write go when it has ended; nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _dropping_shuffles(spark):
        df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing will read again; what was made from them must be stored itself."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path is None:
            raise ValueError("no stored table")
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
