"""Helpers that several text operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that lineage ends here.

    The folder is the session's ``spark.checkpoint.dir``; see shared_folder.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and all of Spark runs in this process, as in tests, is a temporary one made; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Has Spark send rows to Python in Arrow batches of ``rows``, as its own 10,000 whole texts take tens of megabytes on either side.

    Spark reads the setting when a plan runs, so it holds for the session; another value that somebody has set stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def let_go(spark: SparkSession) -> None:
    """Has Spark delete shuffle files that no plan refers to any more, and checkpoints if spark.cleaner.referenceTracking.cleanCheckpoints is set; by itself it
    waits for the driver's memory to fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def durable_by(df: DataFrame, parts: int, key: str) -> DataFrame:
    """Like ``durable``, with the rows dealt to ``parts`` partitions by ``key`` and sorted by it, which later plans know.

    Grouping by the key, or joining something to it, doesn't move these rows again. Adaptive plans don't tell how their rows are
    dealt, so this one plan is made without; the shuffle files behind it are let go at once.
    """
    spark = df.sparkSession
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = durable(df.repartition(parts, key).sortWithinPartitions(key))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    let_go(spark)
    return out


def prefix_sums(df: DataFrame, group: str, order: Sequence[str], size: str, start: str, bucket: Column, rank: str | None = None) -> DataFrame:
    """Adds ``start``: the sum of ``size`` over the rows of the same ``group`` that come before.

    The order in a group is (bucket, *order). A group may hold any share of the rows: each (group, bucket) is
    summed on its own and only its total meets the other totals of the group. ``rank`` adds the number of rows
    before. ``group`` mustn't be null. The totals are merged in, never broadcast: their number grows with the buckets,
    and the size that Spark expects of generated rows says nothing about it.
    """
    laid = df.withColumn("_bucket", bucket).repartition(group, "_bucket")
    inner = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = (
        laid.groupBy(group, "_bucket").agg(F.sum(size).alias("_sum"), F.count("*").alias("_rows"))
        .select(group, "_bucket", (F.sum("_sum").over(outer) - F.col("_sum")).alias("_sum_before"), (F.sum("_rows").over(outer) - F.col("_rows")).alias("_rows_before"))
    )
    out = laid.withColumn("_in", F.sum(size).over(inner) - F.col(size))
    if rank:
        out = out.withColumn("_row", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)) - 1)
    out = out.join(totals.hint("merge"), [group, "_bucket"]).withColumn(start, F.col("_sum_before") + F.col("_in"))
    if rank:
        out = out.withColumn(rank, F.col("_rows_before") + F.col("_row"))
    return out.drop("_bucket", "_in", "_row", "_sum_before", "_rows_before")


def hex_bucket(*columns: str, digits: int = 2) -> Column:
    """16 ** digits buckets by MD5, which other SQL engines can repeat."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    return F.substring(F.md5(text), 1, digits)


def give_back() -> None:
    """Frees what a Python worker's allocators keep, so that an idle worker doesn't hold the memory of its last task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


# --- batches of texts as bytes -------------------------------------------------------------------


def text_slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``most`` bytes of UTF-8; a longer text stands alone. Null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words of the rows; a word never crosses a row's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits each depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0] + 1, ... for each run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def unique_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """(code of each span, distinct spans) of spans in ascending order that don't overlap."""
    sizes = ends - starts
    packed = data[ragged(starts, sizes)]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def byte_hashes(texts: Iterable[bytes]) -> np.ndarray:
    """64-bit XXH3 hashes."""
    return np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)
