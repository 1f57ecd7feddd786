"""Streaming forms: discovered links as a stream, scored frontier upserts by micro-batch, and counts in event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: Micro-batches after which the batches so far are folded into one table.
COMPACT_AFTER = 16


def event_counts(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows of event time; state older than the watermark is dropped. Without `late` nothing is
    late: for a source that is drained once, in any order."""
    timed = events.withWatermark("ts", late) if late else events
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "event_type", "events")


def drain(writer: DataStreamWriter, checkpoint: str, work: Callable[[DataFrame, int], None]) -> None:
    """Run work on each micro-batch until the source has no more."""
    writer.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_counts(counts: DataFrame, checkpoint: str, table: str) -> None:
    """Write the windows that each micro-batch has changed, under its number; a batch that is replayed overwrites itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    drain(counts.writeStream.outputMode("update"), checkpoint, keep)


def latest_counts(spark: SparkSession, table: str) -> DataFrame:
    """Each window's count of the last batch that changed it."""
    rows = spark.read.schema("start timestamp, event_type string, events long, batch int").parquet(table)
    return rows.groupBy("start", "event_type").agg(F.max_by("events", "batch").alias("events"))


UPSERTS = "url string, priority double, seen long"


def folded(rows: DataFrame) -> DataFrame:
    return rows.groupBy("url").agg(F.min("priority").alias("priority"), F.sum("seen").alias("seen"))


def run_upserts(source: DataFrame, checkpoint: str, table: str, compact_after: int = COMPACT_AFTER) -> None:
    """Feed a stream of (url, priority) into a table of the best priority of each url and how often it was seen.

    A micro-batch only writes its own urls, under its number, so a batch that is replayed after a failure overwrites its own
    result. Every compact_after batches all so far are folded into one under the last one's number; `state` reads the newest
    fold and the batches after it.
    """

    def keep(batch: DataFrame, number: int) -> None:
        folded(batch.withColumn("seen", F.lit(1).cast("long"))).write.mode("overwrite").parquet(f"{table}/batch={number}")
        if (number + 1) % compact_after == 0:
            state(batch.sparkSession, table, number).write.mode("overwrite").parquet(f"{table}-folds/upto={number}")

    drain(source.writeStream, checkpoint, keep)


def state(spark: SparkSession, table: str, below: int | None = None) -> DataFrame:
    """(url, priority, seen) of all batches so far; below leaves out a fold of that number, which is being written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{table}-folds")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = [int(f.getPath().getName().partition("=")[2]) for f in (files.listStatus(at) if files.exists(at) else ())]
    done = max((n for n in numbers if below is None or n < below), default=-1)
    rows = spark.read.schema(UPSERTS + ", batch int").parquet(table).filter(F.col("batch") > done).drop("batch")
    if done >= 0:
        rows = rows.unionByName(spark.read.schema(UPSERTS).parquet(f"{table}-folds/upto={done}"))
    return folded(rows)
