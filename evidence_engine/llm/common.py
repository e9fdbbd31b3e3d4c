"""Reading tables, keeping intermediate tables in the shared folder, small helpers."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
#: Bytes of a batch, if it has more than one row.
BATCH_BYTES = 8 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's 10,000 rows, and of at most BATCH_BYTES: a batch of very long texts
    must fit a worker. Plans read these settings when they run, so they stay set."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if not spark.conf.get(_BATCH_BYTES).rstrip("b") == str(BATCH_BYTES):
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def release() -> None:
    """Hand memory that is free back to the system: a worker process lives on, idle, beside those of the next stage.
    Arrow keeps what it has freed apart from the C library."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_eased = [0.0]


def ease() -> None:
    """release() where it is a second or more since the last time: for functions of a group, which don't know a task's last one."""
    if time.monotonic() >= _eased[0]:
        release()
        _eased[0] = time.monotonic() + 1


def freed(rows):
    """rows(batches) with release() at its end."""

    def wrapped(batches):
        try:
            yield from rows(batches)
        finally:
            release()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only where none is set and the session is local
    (tests); on a cluster that would lose rows, so it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="evidence-engine-"))
    return _own_dir[0]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and a lost
    executor costs only the tasks that read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so extra columns of the caller can never clash with ours."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in columns])


def merged(df: DataFrame, key: str, merge, schema: str, width: int = 64) -> DataFrame:
    """Rows of one key merged by merge((key,), pdf) -> pdf in a tree of two levels, so no task holds a row of every task
    before it."""
    part = df.withColumn("merge_part", F.pmod(F.spark_partition_id(), F.lit(width)))
    first = part.groupBy(key, "merge_part").applyInPandas(lambda k, pdf: merge((k[0],), pdf), schema)
    return first.groupBy(key).applyInPandas(merge, schema)
