"""Intermediate tables in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without it (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="trawl-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trawl-{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours by Spark's own file system, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Folders that results read which were handed out; `release` deletes them.
_HANDED_OUT: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Delete the tables behind all results handed out so far; at the end of the program it is called anyway."""
    while _HANDED_OUT:
        spark, path = _HANDED_OUT.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended, and its folder is the caller's to clear
            return


atexit.register(release)


def hand_out(spark: SparkSession, path: str) -> str:
    _HANDED_OUT.append((spark, path))
    return path


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    return _written(df, hand_out(df.sparkSession, fresh_path(df.sparkSession, name)))


#: Rows of text that a Python worker holds at once.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker's memory does not grow with the rows of its partition.

    Results are evaluated after a call has returned, so the session's setting, if it is larger, stays lowered.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Tables in the shared folder that are only read until the end of a with block, which deletes them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.of = spark, [], {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)

    def folder(self, name: str) -> str:
        self.paths.append(fresh_path(self.spark, name))
        return self.paths[-1]

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        out = _written(df, path)
        self.of[id(out)] = (out, path)
        return out

    def drop(self, table: DataFrame) -> None:
        """Delete a table that `write` returned and nothing will read again."""
        _, path = self.of.pop(id(table))
        remove(self.spark, path)
        self.paths.remove(path)

    def replace(self, old: DataFrame, new: DataFrame, name: str) -> DataFrame:
        """Write new, which may read old, then delete old."""
        out = self.write(new, name)
        self.drop(old)
        return out
