"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to a Python worker.
BATCH_ROWS = 2048
BATCH_BYTES = 24 << 20
#: A key is hot when it owns more than 1/HOT_SHARE of the rows, so at most HOT_SHARE keys are hot.
HOT_SHARE = 1000

_REPO = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches and let Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_REPO, *filter(None, paths)])


#: Bytes that a core should have at least before a table is dealt anew.
SMALL = 4 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where they are so few that few tasks would read them; otherwise as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SMALL else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``.

    Where it is unset one is made for sessions on a single machine; a cluster must name its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = Path(tempfile.mkdtemp(prefix="lexiloom-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(_remove, spark, folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended already
        pass


_made: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; it goes when the program ends, or with ``drop_all``."""
    if not _made:
        atexit.register(drop_all, spark)
    path = f"{shared_dir(spark)}/lexiloom-{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def drop_all(spark: SparkSession) -> None:
    """Delete the tables of all operators so far; results that still read them can't be used any more."""
    for path in sorted(_made):
        _remove(spark, path)
    _made.clear()


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, with no lineage left to recompute."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiloom_folder = path
    return out


def drop_written(df: DataFrame, part: str = "") -> None:
    """Delete a table made by ``written``, or a partition's folder of it, that nothing reads any more."""
    _remove(df.sparkSession, f"{df._lexiloom_folder}/{part}")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of plans that are done with."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_of(name: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of many small ``rows`` to a ``table`` with one row a key, whatever a key's share of the rows.

    ``weight`` is the column of ``table`` with the number of rows of the key.  Keys above 1/HOT_SHARE of
    ``total`` are at most HOT_SHARE in number, so their part of ``table`` is broadcast; the others are
    shuffled, and no key among them is large.
    """
    limit = max(1, total // HOT_SHARE)
    hot = F.broadcast(table.filter(F.col(weight) > limit))
    cold = table.filter(F.col(weight) <= limit)
    near = rows.join(hot, keys, "inner")
    far = rows.join(F.broadcast(table.filter(F.col(weight) > limit).select(*keys)), keys, "left_anti")
    return near.unionByName(far.join(cold, keys, "inner"))
