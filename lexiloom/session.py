"""What a Spark session needs for this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def attach(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the session was started from."""
    repo = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if repo not in paths:
        env["PYTHONPATH"] = os.pathsep.join([repo, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``.

    Where it is unset one is made for sessions on a single machine; a cluster must name its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return _own_dir(spark.sparkContext.applicationId)


#: Bytes that a core should have at least before a table is dealt anew.
SMALL = 4 << 20
#: Bytes of texts in one task: the chains of a text take some twenty times its place in a file, and should stay in memory.
LARGE = 16 << 20
#: Bytes of chains in one partition of a shuffle, for the same reason, and most partitions.
PART, MOST_PARTS = 2 << 20, 4096


def _size(df: DataFrame) -> int:
    """Bytes of a table as Catalyst estimates them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is so small that few tasks would read it; otherwise as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _size(df) < cores * SMALL else df


def dealt(df: DataFrame) -> DataFrame:
    """``spread``, and over more tasks where one would read more than LARGE bytes."""
    tasks = -(-_size(df) // LARGE)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks <= MOST_PARTS else spread(df)


def parts(df: DataFrame) -> int:
    """How many partitions a shuffle of chains should have, by the size of the table."""
    spark = df.sparkSession
    usual, size = int(spark.conf.get("spark.sql.shuffle.partitions")), _size(df)
    # A table of unknown size counts as the largest number there is, and as a part of it where columns were taken from it.
    if size >= int(str(spark._jsparkSession.sessionState().conf().defaultSizeInBytes())) >> 10:
        return usual
    return min(max(-(-size // PART), min(usual, spark.sparkContext.defaultParallelism)), MOST_PARTS)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one when the program ends, also where the session has ended before."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def gone() -> None:
        with suppress(Exception):  # Spark's process has ended already
            fs.delete(at, True)

    atexit.register(gone)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [x.getPath().getName() for x in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder another name, which no other one has."""
    at, new = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (path, to))
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at, new):
        raise OSError(f"{path} cannot become {to}")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go at the end of each query that runs meanwhile, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, with no lineage left to recompute."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiloom_folder = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    remove(df.sparkSession, df._lexiloom_folder)


@lru_cache(maxsize=8)
def _own_dir(application: str) -> str:
    folder = tempfile.mkdtemp(prefix="lexiloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return Path(folder).as_uri()
