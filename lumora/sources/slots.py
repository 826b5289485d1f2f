"""Slots: one current row for each key, in a folder of written batches.

A batch writes only the rows that it changes, under its number, so a batch that is repeated after a failure replaces itself.
``current`` takes of each key the row of the highest batch. Every ``every`` batches the slots are merged into a snapshot and what
the snapshot before it covered is deleted, so the folder stays as large as the slots and the changes since. A reader and a
repeated batch find all they need, since the snapshot before the last and the batches after it stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, store: str, kind: str) -> list[int]:
    """The finished batches or snapshots of a store."""
    at, fs = _folder(spark, f"{store}/{kind}")
    if not fs.exists(at):
        return []
    done = [f.getPath() for f in fs.listStatus(at)]
    return sorted(int(p.getName()) for p in done if fs.exists(_folder(spark, f"{p.toString()}/_SUCCESS")[0]))


def _delete(spark: SparkSession, path: str) -> None:
    at, fs = _folder(spark, path)
    fs.delete(at, True)


def put(rows: DataFrame, store: str, key: str, no: int, every: int = 50) -> None:
    """Writes the changed slots of a batch; of several rows of a key the last by ``at`` counts."""
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("at", *[c for c in rest if c != "at"])).alias("x")).select(key, "x.*")
    one.select(rows.columns).write.mode("overwrite").parquet(f"{store}/batches/{no}")
    if (no + 1) % every == 0:
        merge(spark, store, key, no)


def current(spark: SparkSession, store: str, key: str, upto: int | None = None) -> DataFrame | None:
    """The slots; None for a store without any batch. ``upto`` leaves out later batches."""
    fits = lambda n: upto is None or n <= upto
    shots = [n for n in _numbers(spark, store, "snapshots") if fits(n) and n != upto]
    base = shots[-1] if shots else -1
    parts = [f"{store}/snapshots/{base}"] if shots else []
    parts += [f"{store}/batches/{n}" for n in _numbers(spark, store, "batches") if n > base and fits(n)]
    if not parts:
        return None
    rows = spark.read.parquet(*parts).withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)/[^/]*$", 1).cast("long"))
    rest = [c for c in rows.columns if c not in (key, "batch")]
    # a snapshot is older than every batch that is read beside it
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
    return last.select(key, "x.*")


def merge(spark: SparkSession, store: str, key: str, no: int) -> None:
    """Writes the snapshot of all batches up to ``no`` and deletes what the last snapshot before it covered."""
    older = [n for n in _numbers(spark, store, "snapshots") if n < no]
    current(spark, store, key, upto=no).write.mode("overwrite").parquet(f"{store}/snapshots/{no}")
    if older:
        for kind, keep in (("snapshots", older[-1]), ("batches", older[-1] + 1)):
            for n in _numbers(spark, store, kind):
                if n < keep:
                    _delete(spark, f"{store}/{kind}/{n}")
