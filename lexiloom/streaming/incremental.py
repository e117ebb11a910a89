"""Incremental indexing: chain counts of a stream of lines.

Counts only add up, so no watermark is needed and late lines count like others.  The chain counts of each micro-batch are
a folder of its own, written over when the batch is tried again, so that every line counts once.  ``current_counts`` adds
the folders up; a single one is there as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexiloom import session
from lexiloom.operators import exact

#: Of the folders: most chains are stored in the order of their text, where each has most of the one before.
CODEC = "zstd"


def stream_counts(lines: DataFrame, counts_dir: str, checkpoint_dir: str, line_col: str = "line", available_now: bool = True) -> StreamingQuery:
    """Write the chain counts of every micro-batch of a streaming DataFrame of lines."""

    def write(batch: DataFrame, number: int) -> None:
        # What a batch shuffles is gone when its folder is there.
        with session.shuffles_dropped(batch.sparkSession):
            exact.counts_of_lines(batch, line_col).write.mode("overwrite").option("compression", CODEC).parquet(f"{counts_dir}/batch={number}")

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_counts(spark: SparkSession, counts_dir: str) -> DataFrame:
    """chain and n over all micro-batches so far."""
    rows = spark.read.schema("chain string, n long, batch long").parquet(counts_dir).select("chain", "n")
    batches = [x for x in session.names(spark, counts_dir) if x.startswith("batch=")]
    return rows if len(batches) == 1 else exact.counts_of_rows(rows)


def compact(spark: SparkSession, counts_dir: str, to_dir: str) -> None:
    """One table of the counts so far."""
    current_counts(spark, counts_dir).write.mode("errorifexists").parquet(to_dir)
