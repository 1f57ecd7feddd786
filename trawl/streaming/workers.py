"""The crawl's workers as a stream with state: versions of urls, the next slot of a site, and workers that end when idle.

State is kept by site: the next free time, the worker's number and its last entry, and in a map in the state store (not in
memory) the number of times that each url was found. A timer in event time ends a worker that has had no entry for long.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trawl.scratch import fresh_path, remove

REQUESTS = "event_id long, site string, url string, arrival long, delay long"
OUTPUT = "kind string, site string, event_id long, url string, version long, worker long, at_us long"
NUMBERS = {c: "Int64" for c in ("event_id", "version", "worker", "at_us")}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Workers(StatefulProcessor):
    """Entries are served in order of arrival, then event_id, within a micro-batch; batches follow each other in time.

    Output is a row `entry` for each request (at_us: its slot) and a row `ended` for each worker that was idle for longer
    than `idle` microseconds (at_us: when its patience ran out). The next entry of the site starts a new worker.
    """

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.site = handle.getValueState("site", "free long, last long, worker long, open boolean")
        self.found = handle.getMapState("found", "url string", "times long")

    def _expiry(self, last: int) -> int:
        """The millisecond of event time from which a worker with this last entry is known to be idle."""
        return (last + self.idle) // 1000 + 1

    def _ended(self, key: Any, last: int, worker: int) -> tuple:
        return ("ended", key[0], None, None, None, worker, last + self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["arrival", "event_id"])
        known = self.site.get() if self.site.exists() else None
        free, last, worker, open_ = known if known is not None else (0, None, 0, True)
        arrival, delay = batch["arrival"].to_numpy(np.int64), batch["delay"].to_numpy(np.int64)
        # an entry after a long gap starts the next worker; the one before it has ended, if no timer said so
        ahead = np.r_[arrival[0] if last is None else last, arrival[:-1]]
        fresh = arrival - ahead > self.idle
        number = worker + np.cumsum(fresh)
        told = fresh & np.r_[open_, np.ones(len(fresh) - 1, bool)]
        out = [self._ended(key, int(at), int(n) - 1) for at, n in zip(ahead[told], number[told], strict=True)]
        # a slot is not before its entry nor before the one ahead and its delay
        passed = np.cumsum(delay) - delay
        start = passed + np.maximum(np.maximum.accumulate(arrival - passed), free)
        # the state is asked and told once a url, however often a batch has it
        code, urls = pd.factorize(batch["url"], use_na_sentinel=False)
        before = np.zeros(len(urls), np.int64)
        for i, (url, n) in enumerate(zip(urls, np.bincount(code), strict=True)):
            name = (None if pd.isna(url) else url,)
            known = self.found.getValue(name)
            before[i] = known[0] if known is not None else 0
            self.found.updateValue(name, (int(before[i] + n),))
        version = before[code] + pd.Series(code).groupby(code).cumcount().to_numpy()
        entries = pd.DataFrame({"kind": "entry", "site": key[0], "event_id": batch["event_id"].to_numpy(), "url": batch["url"].to_numpy(), "version": version, "worker": number, "at_us": start})
        if last is not None:
            self.handle.deleteTimer(self._expiry(last))
        free, last, worker = int(start[-1] + delay[-1]), int(arrival[-1]), int(number[-1])
        self.handle.registerTimer(self._expiry(last))
        self.site.update((free, last, worker, True))
        if out:
            yield _frame(out)
        yield entries.astype(NUMBERS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        free, last, worker, open_ = self.site.get()
        fires = open_ and expiredTimerInfo.getExpiryTimeInMs() == self._expiry(last)
        if fires:
            self.site.update((free, last, worker, False))
        yield _frame([self._ended(key, last, worker)] if fires else [])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype(NUMBERS)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def write_in_order(rows: DataFrame, folder: str, time: str, parts: int) -> None:
    """Write rows as files that follow each other in time, for a stream that reads one after the other: `parts` spans of
    equal length, each of one file or more, written span by span. Rows are dealt to the spans in one pass."""
    span = rows.agg(F.min(time).alias("a"), F.max(time).alias("b")).first()
    if span["a"] is None:
        rows.limit(0).write.mode("append").parquet(folder)
        return
    width = (span["b"] - span["a"]) // parts + 1
    staged = fresh_path(rows.sparkSession, "spans")
    rows.withColumn("_span", F.floor((F.col(time) - span["a"]) / width)).write.partitionBy("_span").parquet(staged)
    dealt = rows.sparkSession.read.schema(f"{_ddl(rows)}, _span long").parquet(staged)
    for k in range(parts):
        dealt.filter(F.col("_span") == k).drop("_span").coalesce(1).write.mode("append").parquet(folder)
    remove(rows.sparkSession, staged)


def run(spark: SparkSession, source: str, table: str, checkpoint: str, idle: int) -> DataFrame:
    """Drain what has come to the folder source since the last run with this checkpoint, and return the whole table.

    A micro-batch takes one file of the source; the table's own log leaves out files of a batch that died, so running again
    neither loses nor repeats a row.
    """
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        rows = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(source)
        timed = rows.withColumn("ts", F.timestamp_micros("arrival")).withWatermark("ts", "0 seconds")
        out = timed.groupBy("site").transformWithStateInPandas(Workers(idle), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
        writer = out.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(OUTPUT).parquet(table)
