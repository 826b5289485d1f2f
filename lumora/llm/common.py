"""Helpers that the training-data operators share.

Conventions of every operator in this package:

* only the named columns of an input are read, so extra columns, whatever their names, do no harm;
* a null text is an empty text; a null key stays null in the result; repeated rows stay repeated rows;
* an empty table gives an empty result with the same columns;
* intermediate tables live in the folder of ``spark.checkpoint.dir``, which driver and executors share, so that lost
  executors cost a recomputation of their own partitions only.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are none of space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: a temporary one on a single machine (tests), an error on a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumora-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Remove tables made by ``stored`` whose last reader has been stored itself."""
    for t in tables:
        if (path := _paths.pop(t, None)) is not None:
            delete(t.sparkSession, path)


def hold_splits(spark: SparkSession) -> None:
    """Fix the number of cores by which scans are cut, so that two scans of a table have the same partitions even if an
    executor is lost or joins between them. Does nothing where the session sets it."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(max(1, spark.sparkContext.defaultParallelism)))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nobody refers to any more, before more are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
