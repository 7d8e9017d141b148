"""Streams of events: fixed segments, first sightings, and the last values of a key."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from plotloom.operators.prefix import running


def segments(events: DataFrame, length: str = "80 seconds", late: str = "10 minutes") -> DataFrame:
    """Count and sum of (ts, value) in tumbling segments; the same code on a table and on a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def first_seen(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Drops what was seen before; on a stream, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def look_back(events: DataFrame, key: str, value: str, keep: int = 20, forget: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """For each batch of a stream and key: lower median, mean, max and last of the last ``keep`` values, by time of arrival; see rows_in_order for
    a row's own frame, whatever came late. A key that nothing came for in ``forget`` of event time is forgotten, so that the state stays that of the keys in use.
    """
    wait = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        values = list(state.get[0]) if state.exists else []
        fresh = pd.concat(list(frames)).sort_values("ts")
        values = (values + fresh[value].tolist())[-keep:]
        state.update((values,))
        state.setTimeoutTimestamp(max(int(fresh["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + wait)
        ordered = sorted(values)
        yield pd.DataFrame([(str(name[0]), ordered[(len(ordered) - 1) // 2], sum(values) / len(values), ordered[-1], values[-1])], columns=["key", "median", "mean", "max", "last"])

    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, "key string, median double, mean double, max double, last double", "values array<double>", "update", "EventTimeTimeout")


#: A waiting or held row; ``none`` is 1 where the key is null.
_ROW = np.dtype([("none", "i1"), ("key", "<i8"), ("at", "<i8"), ("id", "<i8"), ("value", "<f8")])


class LookBack(StatefulProcessor):
    """Rows (none, key, at, id, value) of a bucket of keys, for each key in the order of (at, id), however they arrive within the watermark, each with figures of the last ``keep`` values.

    Rows wait in a list until the watermark has passed the last that came with them, which one timer for each bucket and batch tells; what came late has
    taken its place by then. Another state holds the rows that the next one of a key looks back on. A key that nothing came for in ``forget`` ms of
    event time is forgotten, by a timer too, so the state stays that of the keys in use. Times are microseconds. Each state is packed rows, a call for
    a bucket, not for a key or a row, and all keys of a bucket are sorted and framed at once. A null or NaN value counts in n, but has no part in the figures.
    """

    def __init__(self, keep: int, forget: int):
        self.keep, self.forget = keep, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.held = handle.getValueState("held", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for fresh in rows:
            if not len(fresh):
                continue
            if fresh[["at", "id"]].isna().any(axis=None):
                raise ValueError("a row without a time or a number has no place in the order")
            own = np.empty(len(fresh), _ROW)
            for c in _ROW.names:
                own[c] = fresh[c].to_numpy()
            self.waiting.appendValue((own.tobytes(),))
            last = own["at"].max() if last is None else max(last, own["at"].max())
        if last is not None:
            self.handle.registerTimer(-(-int(last) // 1000))
        return iter(())

    def _ends(self, at: np.ndarray) -> np.ndarray:
        """Until when, in microseconds, a key is kept whose last row was at this time."""
        return 1000 * (-(-at // 1000) + self.forget)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = 1000 * expiredTimerInfo.getExpiryTimeInMs()
        waiting = np.frombuffer(b"".join(bytes(r[0]) for r in self.waiting.get()) if self.waiting.exists() else b"", _ROW)
        held = np.frombuffer(bytes(self.held.get()[0]) if self.held.exists() else b"", _ROW)
        due = waiting["at"] <= now
        rows, fresh = np.concatenate([held, waiting[due]]), np.repeat([False, True], [len(held), due.sum()])
        if not len(rows):
            return
        order = np.lexsort((rows["id"], rows["at"], fresh, rows["key"], rows["none"]))
        rows, fresh = rows[order], fresh[order]
        edge = np.append(True, (rows["key"][1:] != rows["key"][:-1]) | (rows["none"][1:] != rows["none"][:-1]))  # a key's first row
        first = edge | np.append(False, rows["at"][1:] > self._ends(rows["at"][:-1]))  # that, or the first after the key was forgotten
        begin, end = np.flatnonzero(first), np.append(np.flatnonzero(first)[1:], len(rows))
        place = np.arange(len(rows)) - np.repeat(begin, end - begin)
        kept = np.repeat(np.append(edge[begin[1:]], True) & (self._ends(rows["at"][end - 1]) > now), end - begin)  # what comes next looks back on these
        kept &= np.repeat(end, end - begin) - np.arange(len(rows)) <= self.keep
        left = rows[kept]
        if not len(left):
            self.held.clear()
        else:
            if due.any() or len(left) != len(held):
                self.held.update((left.tobytes(),))
            last = np.append((left["key"][1:] != left["key"][:-1]) | (left["none"][1:] != left["none"][:-1]), True)
            self.handle.registerTimer(int(self._ends(left["at"][last]).min() // 1000))
        if not due.any():
            return
        if due.all():
            self.waiting.clear()
        else:
            self.waiting.put([(waiting[~due].tobytes(),)])
        frames = np.lib.stride_tricks.sliding_window_view(np.append(np.full(self.keep - 1, np.nan), rows["value"]), self.keep)
        back = np.arange(self.keep - 1, -1, -1)
        new = np.flatnonzero(fresh)
        for at in range(0, len(new), 1 << 14):
            some = new[at : at + (1 << 14)]
            own = np.where(back <= place[some, None], frames[some], np.nan)
            size = self.keep - np.isnan(own).sum(axis=1)
            total = np.nansum(own, axis=1)
            own.sort(axis=1)  # what is no number comes last
            top = np.maximum(size - 1, 0)
            each, line = rows[some], np.arange(len(some))
            yield pd.DataFrame({
                "key": pd.Series(each["key"], dtype="Int64").mask(each["none"] == 1), "id": each["id"], "at": each["at"], "n": np.minimum(place[some] + 1, self.keep), "median": own[line, top // 2],
                "mean": total / np.where(size, size, np.nan), "highest": own[line, top], "latest": each["value"],
            })

    def close(self) -> None:
        pass


def rows_in_order(events: DataFrame, key: str, number: str, value: str, keep: int = 20, forget: str = "1 day", late: str = "10 minutes", buckets: int = 512) -> DataFrame:
    """Of a stream with ``ts``: for each row, once the watermark has passed it, count, lower median, mean, highest and latest of the last ``keep`` values of its key.

    (key, id, ts, n, median, mean, highest, latest), where rows of a key are in the order of time and ``number``, as in a frame of rows over a table. Keys share
    ``buckets`` states by their hash, so that what each key costs is its rows; a bucket's waiting rows fit in memory. The
    session needs a state store that knows timers; see timed_session.
    """
    rows = events.withWatermark("ts", late).select(F.col(key).cast("long").alias("key"), "ts", F.unix_micros("ts").alias("at"), F.col(number).cast("long").alias("id"), F.col(value).cast("double").alias("value"))
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), F.isnull("key").cast("int").alias("none"), F.coalesce("key", F.lit(0)).alias("key"), "ts", "at", "id", "value")
    schema = "key long, id long, at long, n long, median double, mean double, highest double, latest double"
    wait = int(pd.Timedelta(forget).total_seconds() * 1000)
    out = rows.groupBy("bucket").transformWithStateInPandas(LookBack(keep, wait), schema, "Append", "EventTime")
    return out.select("key", "id", F.timestamp_micros("at").alias("ts"), "n", "median", "mean", "highest", "latest")


def timed_session(spark: SparkSession) -> SparkSession:
    """A session beside the user's, with its shuffles and time zone, whose streams keep state in RocksDB, as timers need."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def with_resume(source: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs ``work`` over what the source has that no earlier run finished, and appends its rows as parquet; a finished batch is marked in the checkpoint."""

    def batch(rows: DataFrame, number: int) -> None:
        work(rows).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is run again replaces itself

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def interleaved(streams: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """The rows of several streams with their source's name; how they alternate is the trigger's; ``orders.interleave_stream`` gives each its share."""
    out = None
    for rows, name in zip(streams, names, strict=True):
        one = rows.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def endless(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    """(ts, value) without an end."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().withColumnRenamed("timestamp", "ts")


def epochs(rows: DataFrame, order: Sequence[str], rows_per_second: int = 10) -> DataFrame:
    """A stream without an end of a table's rows, in their order, again and again: (ts, epoch, place, *rows).

    Each number of a counting source is a place of an epoch, which meets the numbered table; so the stream keeps no state but the count, and goes on after a restart
    where its checkpoint says. The table is counted once; an empty one gives no rows.
    """
    spark = rows.sparkSession
    n = rows.count()
    numbered = running(rows, order, place="place").withColumnRenamed("place", "_place")
    count = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    ticks = count.select(F.col("timestamp").alias("ts"), F.floor(F.col("value") / max(1, n)).alias("epoch"), (F.col("value") % max(1, n)).alias("place"))
    return ticks.join(numbered, F.col("place") == F.col("_place")).drop("_place")


def poll(ready: Callable[[], bool], tries: int = 10, wait: float = 0.5) -> bool:
    """Asks until it is ready, ``tries`` times at most, waiting twice as long each time."""
    for k in range(tries):
        if ready():
            return True
        time.sleep(min(60.0, wait * 2**k))
    return ready()


def stream(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of parquet files, ``files`` at a time, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
