"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset is another one
    chosen: beside the warehouse, or for a local master a new temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        local = spark.sparkContext.master.split("[")[0] == "local"
        folder = tempfile.mkdtemp(prefix="tarnwick-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def cut(df: DataFrame, together: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor costs nothing. What was shuffled for it is deleted at once.

    together: so many rows at most are held at once when the table is written and read. For rows of megabytes: otherwise Parquet holds a hundred
    of them at least, and Spark unpacks 4,096 at a time or as many as were held.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.options(**{"parquet.block.row.count.limit": together} if together else {}).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.cut_path = path
    return read


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing will read them again (what came of them is cut itself)."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str | int) -> Iterator[None]:
    """While it lasts, the session has this setting."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, Python workers get at most so many rows at once (fewer if the session says so): whole texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    with setting(spark, name, min(rows, before) if before > 0 else rows):
        yield


def give_back() -> None:
    """In a Python worker: memory that is free goes back to the system. Workers outlive their tasks, and those of several stages stand side by side in an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # this system's C library has no such call


def crc32_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as remainder 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(n), F.lit(0)).cast("int")


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
