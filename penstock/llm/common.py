"""What the training-data operators share: the work folder, materialised tables and Arrow plumbing."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch between the JVM and a Python worker, so that a batch stays in tens of MB.
BATCH_ROWS = 1000
#: Bytes of text after which an operator cuts its own output batches.
BATCH_BYTES = 16 << 20
#: With it, Spark deletes the shuffle files of a query as soon as the query has ended, not when the driver's garbage is collected.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="penstock-")
        spark.conf.set("spark.checkpoint.dir", base)
    # with the scheme that Spark would take, so that Python tasks open the same place
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared work folder and read it back: lineage is cut and any executor can read it.

    The shuffle files of the write go with it: the table has all that is read later.
    """
    spark = df.sparkSession
    path, before = fresh_folder(spark, name), spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_END)
        else:
            spark.conf.set(SHUFFLES_END, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, table.written_to)


_held: list[str] = []
_holding = False


def hold(table: DataFrame) -> DataFrame:
    """A materialised table that a lazy result still reads; in a stage of a pipeline it is deleted when the next stage begins."""
    if _holding:
        _held.append(table.written_to)
    return table


@contextmanager
def stage_work(spark: SparkSession) -> Iterator[None]:
    """Around a stage of a pipeline, whose result is written before the next one begins: deletes what the last stage held."""
    global _holding
    while _held:
        delete(spark, _held.pop())
    free_shuffles(spark)
    _holding = True
    try:
        yield
    finally:
        _holding = False


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of jobs that have ended: it acts when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch unless the session already has a lower bound: Spark has no narrower scope for it."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < size(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI such as file:, hdfs: or s3:; a plain path is local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of anything but the six ASCII space characters: what bytes.split() gives."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


#: The six ASCII space characters as a Java character class.
SPACES = r"[\x20\x09-\x0D]"


def n_words_column(text: str):
    """Number of words of a text column, JVM-side; null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
