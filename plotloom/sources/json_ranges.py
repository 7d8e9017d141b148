"""Large JSON files, each a list, an object of values, or an object with a list in it, read by byte ranges in many tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotloom.sources.scratch import store_of, stored

_BLOCK, _TASK = 1 << 20, 32 << 20
_MARKS = np.zeros(256, bool)
_MARKS[list(b'"[]{},')] = True
_RANGE = "path string, at long, start long, stop long"


@dataclass
class Marks:
    """The structural characters of a block outside of strings: their places in it, what they are, and the depth behind each; then the state behind the block."""

    at: np.ndarray
    what: np.ndarray
    depth: np.ndarray
    inside: bool
    level: int
    odd: bool


def marks(data: np.ndarray, inside: bool, level: int, odd: bool) -> Marks:
    """Reads a block that begins inside a string or not, at a depth, and behind an odd run of backslashes or not."""
    slashes = np.flatnonzero(data == 0x5C)
    escaped = np.zeros(len(data) + 1, bool)
    if odd and len(data) and data[0] != 0x5C:
        escaped[0] = True
    if len(slashes):
        first = np.concatenate([[True], np.diff(slashes) > 1])
        begin = slashes[first]
        length = np.diff(np.append(np.flatnonzero(first), len(slashes)))
        length = length + (odd & (begin == 0))  # a run goes on from the block before
        escaped[(begin + np.diff(np.append(np.flatnonzero(first), len(slashes))))[length % 2 == 1]] = True
    at = np.flatnonzero(_MARKS[data] & ~escaped[:-1])
    what = data[at]
    quote = what == 0x22
    in_string = (np.cumsum(quote) + inside) % 2 == 1
    out = ~in_string & ~quote
    at, kind = at[out], what[out]
    step = np.where((kind == 0x5B) | (kind == 0x7B), 1, np.where((kind == 0x5D) | (kind == 0x7D), -1, 0))
    depth = level + np.cumsum(step)
    return Marks(at, kind, depth, bool((int(quote.sum()) + inside) % 2), int(depth[-1]) if len(depth) else level, bool(escaped[-1]))


class _File:
    def __init__(self, path: str):
        store, place = store_of(path)
        self.file = store.open_input_file(place)
        self.size = self.file.size()

    def read(self, start: int, n: int) -> np.ndarray:
        self.file.seek(start)
        return np.frombuffer(self.file.read(max(0, min(n, self.size - start))), np.uint8)

    def odd(self, start: int) -> bool:
        """Whether an odd number of backslashes stands before a place."""
        count = 0
        while start - count > 0:
            before = self.read(max(0, start - count - 4096), min(4096, start - count))
            other = np.flatnonzero(before != 0x5C)
            if len(other):
                return (count + len(before) - 1 - int(other[-1])) % 2 == 1
            count += len(before)
        return count % 2 == 1

    def blocks(self, start: int, stop: int, inside: bool, level: int, own: int | None = None) -> Iterator[tuple[int, np.ndarray, Marks]]:
        """The blocks from ``start`` to ``stop``; with ``own`` a block ends there, and those behind it begin small and double, as few bytes of them may be wanted."""
        odd, step = self.odd(start), min(_BLOCK, 1 << 12)
        while start < stop:
            size = _BLOCK if own is None else min(_BLOCK, own - start) if start < own else step
            step = min(_BLOCK, 2 * step) if own is not None and start >= own else step
            data = self.read(start, min(size, stop - start))
            if not len(data):
                return
            found = marks(data, inside, level, odd)
            yield start, data, found
            inside, level, odd = found.inside, found.level, found.odd
            start += len(data)


def _ranges(spark: SparkSession, paths: Sequence[str], range_bytes: int) -> tuple[DataFrame, int]:
    """The files' ranges, dealt to tasks, and how many tasks."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length")  # sizes only; no file is read
    last = F.greatest(F.ceil(F.col("length") / range_bytes) - 1, F.lit(0))
    rows = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("at"))
    dealt = rows.select("path", "at", (F.col("at") * range_bytes).alias("start"), F.least((F.col("at") + 1) * range_bytes, F.col("length")).alias("stop"))
    tasks = _tasks(rows)
    return dealt.repartition(tasks, "path", "at"), tasks


def _tasks(ranges: DataFrame) -> int:
    """A task for each range, as long as those aren't far more than the cores, then one for some ``_TASK`` bytes: small ranges are many to a task."""
    found = ranges.agg(F.count("*").alias("n"), F.sum(F.when(F.col("at") == 0, F.col("length"))).alias("bytes")).first()
    return max(1, min(found["n"], max(4 * ranges.sparkSession.sparkContext.defaultParallelism, -(-(found["bytes"] or 0) // _TASK))))


def _each(f, schema: str):
    """A function of a range's row, run over the rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [c.split(" ")[0] for c in schema.split(", ")]
        for b in batches:
            for row in b.to_pylist():
                for part in f(row):
                    yield pa.RecordBatch.from_pydict({c: part[c] for c in fields})

    return run


def _states(ranges: DataFrame) -> DataFrame:
    """(path, at, start, stop, inside, level): whether each range begins in a string, and at which depth.

    A range is read once for both cases, as it can't know what stands before; the cases are then chosen from the first range on: only numbers meet, a row a range.
    """

    def summary(row: dict) -> Iterator[dict]:
        file, level, inside = _File(row["path"]), [0, 0], [False, True]
        odd, start = file.odd(row["start"]), row["start"]
        while start < row["stop"]:
            data = file.read(start, min(_BLOCK, row["stop"] - start))
            found = [marks(data, inside[k], level[k], odd) for k in (0, 1)]
            inside, level, odd = [m.inside for m in found], [m.level for m in found], found[0].odd
            start += len(data)
        yield {"path": [row["path"]], "at": [row["at"]], "start": [row["start"]], "stop": [row["stop"]], "flips": [int(inside[0])], "outside": [level[0]], "within": [level[1]]}

    schema = f"{_RANGE}, flips long, outside long, within long"
    found = stored(ranges.mapInArrow(_each(summary, schema), schema), "json-ranges")
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.withColumn("inside", F.coalesce(F.sum("flips").over(before) % 2, F.lit(0)) == 1).withColumn("_step", F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside")))
    return rows.select("path", "at", "start", "stop", "inside", F.coalesce(F.sum("_step").over(before), F.lit(0)).cast("long").alias("level"))


def _envelope(states: DataFrame, field: str) -> DataFrame:
    """(path, low, high): the places behind which and before which the value of a key of the outer object lies; of two equal keys the later counts."""
    name = f'"{field}"'.encode()

    def find(row: dict) -> Iterator[dict]:
        file = _File(row["path"])
        places, kinds = [], []
        for start, data, m in file.blocks(row["start"], row["stop"], row["inside"], row["level"]):
            ends = m.at[((m.what == 0x2C) & (m.depth == 1)) | ((m.what == 0x7D) & (m.depth == 0))]
            begins = m.at[((m.what == 0x2C) & (m.depth == 1)) | ((m.what == 0x7B) & (m.depth == 1))]
            places += (start + ends).tolist()
            kinds += ["end"] * len(ends)
            for at in begins:  # a key follows; it may reach into the next range
                head, behind = b"", start + int(at) + 1
                while len(head) <= len(name) and (piece := file.read(behind, 256).tobytes()):
                    behind += len(piece)
                    head = (head + piece).lstrip(b" \t\r\n")
                if head.startswith(name):
                    places.append(start + int(at))
                    kinds.append("key")
        if places:
            yield {"path": [row["path"]] * len(places), "place": places, "kind": kinds}

    found = stored(states.mapInArrow(_each(find, "path string, place long, kind string"), "path string, place long, kind string"), "json-keys")
    low = found.where("kind = 'key'").groupBy("path").agg(F.max("place").alias("low"))
    return found.where("kind = 'end'").join(low, "path").where("place > low").groupBy("path", "low").agg(F.min("place").alias("high"))


def elements(spark: SparkSession, paths: str | Sequence[str], field: str | None = None, range_bytes: int = 32 << 20) -> DataFrame:
    """(path, number, start, body) of the elements of each file's outer list or object, or of those of the value of ``field`` in its outer object.

    body is an element's text, in an object with its key before it; number counts from 0 in the file's order, as a parse from the front would. The file is
    read in ranges of ``range_bytes``: first for quotes and brackets, which tells how deep each range begins and whether in a string, then for the elements that
    begin in it, the last of which is read on to its end. So a file of any size is many tasks' work, and a task holds one element.
    """
    ranges, tasks = _ranges(spark, [paths] if isinstance(paths, str) else list(paths), range_bytes)
    states = _states(ranges).repartition(tasks, "path", "at")  # a few numbers a range, which Spark would bring to few tasks
    level = 1 if field is None else 2
    if field is None:
        states = states.withColumn("low", F.lit(-1).cast("long")).withColumn("high", F.lit((1 << 63) - 1))
    else:
        states = states.join(F.broadcast(_envelope(states, field)), "path")  # a row a file

    def starts_of(m: Marks, start: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(places behind which an element begins, places at which one ends) of a block."""
        place = m.at + start
        own = (place > low) & (place < high)
        opens = own & (((m.what == 0x5B) | (m.what == 0x7B)) & (m.depth == level))
        comma = own & (m.what == 0x2C) & (m.depth == level)
        closes = own & (((m.what == 0x5D) | (m.what == 0x7D)) & (m.depth == level - 1))
        return place[opens | comma], place[comma | closes]

    def read(row: dict) -> Iterator[dict]:
        file = _File(row["path"])
        number, held, since = 0, None, 0  # the element that is open: its bytes so far, and where it began
        done: list[tuple[int, int, str]] = []
        size = 0
        for start, data, m in file.blocks(row["start"], file.size, row["inside"], row["level"], row["stop"]):
            past = start >= row["stop"]
            if past and held is None:
                break
            begins, ends = starts_of(m, start, row["low"], row["high"])
            if held is None and not len(begins):
                continue
            events = sorted([(int(p), 0) for p in ends] + [(int(p), 1) for p in begins])
            for place, kind in events:
                if kind == 0 and held is not None:
                    held.append(data[max(0, since - start) : place - start].tobytes())
                    body = b"".join(held).strip(b" \t\r\n")
                    held = None
                    if body:
                        done.append((number, since, body.decode("utf-8", "replace")))
                        number, size = number + 1, size + len(body)
                elif kind == 1 and place < row["stop"]:
                    held, since = [], place + 1
            if held is not None:
                held.append(data[max(0, since - start) :].tobytes())
            if size > 4 << 20:
                yield {"path": [row["path"]] * len(done), "at": [row["at"]] * len(done), "place": [d[0] for d in done], "start": [d[1] for d in done], "body": [d[2] for d in done]}
                done, size = [], 0
        if done:
            yield {"path": [row["path"]] * len(done), "at": [row["at"]] * len(done), "place": [d[0] for d in done], "start": [d[1] for d in done], "body": [d[2] for d in done]}

    schema = "path string, at long, place long, start long, body string"
    rows = stored(states.mapInArrow(_each(read, schema), schema), "json-elements")
    counts = rows.groupBy("path", "at").agg(F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("path", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    return rows.join(first, ["path", "at"]).select("path", (F.col("_first") + F.col("place")).alias("number"), "start", "body")


def keyed_body(body, schema: str):
    """(key, value) columns of an element of an object: its text is ``"key": value``."""
    pair = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), f"map<string,struct<{schema}>>")
    return F.get(F.map_keys(pair), 0), F.get(F.map_values(pair), 0)
