"""Orders for training: a shuffle through a bounded buffer, and sources interleaved by weight, on tables and on streams."""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plotloom.operators.prefix import running
from plotloom.sources.scratch import store_of


def shuffle_buffer(rows: DataFrame, buffer: int, seed: int = 0, epochs: int = 1) -> DataFrame:
    """Each row once an epoch, in the order of a shuffle buffer of ``buffer`` rows over each partition's stream: adds epoch, part and place.

    The i-th row of a partition gets the key i + buffer * u with u drawn from [0, 1) by seed, epoch, partition and i, and rows leave in the order of
    their keys: once row i has come, all with a key up to i can go. So a task holds at most ``buffer`` rows beside the batch that it reads, no row is sorted
    against the whole table or moved to another partition, and no row moves by ``buffer`` places or more. The same partitions give the same order.
    """
    columns = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def mixed(epoch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, rng, held, keys, came, left = 0, None, None, np.zeros(0), 0, 0

            def out(table: pa.Table) -> pa.RecordBatch:
                nonlocal left
                n = table.num_rows
                extra = {"epoch": np.full(n, epoch, np.int32), "part": np.full(n, part, np.int32), "place": np.arange(left, left + n)}
                left += n
                body = table.combine_chunks().to_batches()[0]
                return pa.RecordBatch.from_arrays([*body.columns, *map(pa.array, extra.values())], [*columns, *extra])

            for b in batches:
                if rng is None and b.num_rows:
                    part = b.column("_part")[0].as_py()
                    rng = np.random.default_rng([seed, epoch, part])
                b = b.select(columns)
                for at in range(0, b.num_rows, buffer):  # a large batch is fed in steps, so that no more than two buffers are ever held
                    step = b.slice(at, buffer)
                    keys = np.concatenate([keys, came + np.arange(step.num_rows) + buffer * rng.random(step.num_rows)])
                    came += step.num_rows
                    new = pa.Table.from_batches([step])
                    held = new if held is None else pa.concat_tables([held, new])
                    order = np.argsort(keys, kind="stable")
                    go = int(np.searchsorted(keys[order], came))  # later rows have keys of came or more
                    if go:
                        yield out(held.take(order[:go]))
                    stay = np.sort(order[go:])
                    held, keys = held.take(stay), keys[stay]
            if held is not None and held.num_rows:
                yield out(held.take(np.argsort(keys, kind="stable")))

        return run

    found = None
    for epoch in range(epochs):
        own = rows.withColumn("_part", F.spark_partition_id()).mapInArrow(mixed(epoch), f"{fields}, epoch int, part int, place long")
        found = own if found is None else found.unionByName(own)
    return found


# --- interleaving by weight ----------------------------------------------------------------------


def pattern(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """The slots of each source in a period of sum(weights) slots, so spread that after any n slots a source has had within one of n * its share.

    Row i of a source may come from slot floor(i / share) on and must by ceil((i + 1) / share); of those that may, the one that must first comes first.
    """
    divisor = math.gcd(*weights.values())
    whole = {s: w // divisor for s, w in weights.items()}
    total = sum(whole.values())
    waiting: list[tuple[int, int, str]] = [(0, 0, s) for s in sorted(whole)]  # (from which slot, row, source)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in whole}
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // whole[s]), s, i))
        _, s, i = heapq.heappop(ready)
        out[s].append(slot)
        if i + 1 < whole[s]:
            heapq.heappush(waiting, ((i + 1) * total // whole[s], i + 1, s))
    return out


class Phase:
    """A stretch of the order in which the same sources take part: from position ``start``, with ``taken`` rows of each source before it."""

    def __init__(self, start: int, taken: Mapping[str, int], weights: Mapping[str, int]):
        self.start, self.taken, self.weights = start, dict(taken), dict(weights)
        self.slots = pattern(weights)
        self.period = sum(map(len, self.slots.values()))

    def place(self, source: str, row: int) -> int:
        """The position of a source's row, numbered from 0 over all phases."""
        own, i = self.slots[source], row - self.taken[source]
        return self.start + i // len(own) * self.period + own[i % len(own)]

    def taken_before(self, position: int) -> dict[str, int]:
        """Rows of each source in the positions before one."""
        turns, rest = divmod(position - self.start, self.period)
        return self.taken | {s: self.taken[s] + turns * len(own) + sum(x < rest for x in own) for s, own in self.slots.items()}


def phases(sizes: Mapping[str, int | None], weights: Mapping[str, int]) -> list[Phase]:
    """The phases of sources with so many rows; None stands for one whose end isn't known. A phase ends with the last row of a source, whose share the others get."""
    out, taken, start = [], dict.fromkeys(weights, 0), 0
    left = {s: w for s, w in weights.items() if w > 0 and sizes.get(s) != 0}
    while left:
        own = Phase(start, taken, left)
        out.append(own)
        ends = [own.place(s, sizes[s] - 1) + 1 for s in left if sizes.get(s) is not None]
        if not ends:
            break
        start = min(ends)
        taken = own.taken_before(start)
        left = {s: w for s, w in left.items() if sizes.get(s) is None or taken[s] < sizes[s]}
    return out


def _position(source: str, row: str, stretches: Sequence[Phase]):
    """The position of a row, numbered in its source, as a column; null for a source that takes no part."""
    out = F.lit(None).cast("long")
    for k, p in reversed(list(enumerate(stretches))):
        end = stretches[k + 1].taken if k + 1 < len(stretches) else None
        for s, own in p.slots.items():
            i = F.col(row) - p.taken[s]
            at = F.lit(p.start) + F.floor(i / len(own)) * p.period + F.element_at(F.array(*map(F.lit, own)), (i % len(own) + 1).cast("int"))
            inside = (F.col(source) == s) & (F.col(row) >= p.taken[s])
            out = F.when(inside if end is None else inside & (F.col(row) < end[s]), at.cast("long")).otherwise(out)
    return out


def interleaved(rows: DataFrame, source: str, order: Sequence[str], weights: Mapping[str, int], name: str = "position") -> DataFrame:
    """Adds ``name``: places of the rows of all sources of ``weights``, whole numbers, one after another without gaps; sources without a weight are left out.

    While the same sources have rows left, after n places each has had within one row of n * its share, and a source that ends hands its share to the
    others. A source's rows come in ``order``. Positions follow from a row's number in its source, so no rows meet but for numbering in buckets.
    """
    own = rows.where(F.col(source).isin([s for s, w in weights.items() if w > 0]))
    sizes = {r[0]: r[1] for r in own.groupBy(source).count().collect()}  # a row a source of the configuration
    numbered = running(own, order, place="_row", by=[source])
    return numbered.withColumn(name, _position(source, "_row", phases({s: sizes.get(s, 0) for s in weights}, weights))).drop("_row")


def interleave_stream(stream: DataFrame, source: str, order: Sequence[str], weights: Mapping[str, int], out: str, state: str, checkpoint: str, end: str | None = None) -> StreamingQuery:
    """Writes the rows of a stream with their ``position`` to ``out``, interleaved as ``interleaved`` does, with what each source is owed kept across micro-batches.

    A batch numbers its rows behind those that came before, by ``order`` in the batch, and writes those whose turn has come: all before the first place
    whose row isn't there yet. The others wait in ``state``, beside how many rows of each source have come. A row of a source with ``end`` true
    is no row, but says that the source has no more. A batch that is run again starts from the state before it and replaces what it wrote.
    """

    def note(number: int) -> str:
        return f"{state}/seen-{number}.json"

    def batch(fresh: DataFrame, number: int) -> None:
        spark = fresh.sparkSession
        store, path = store_of(note(number - 1))
        before = json.loads(store.open_input_stream(path).read()) if number else {"seen": dict.fromkeys(weights, 0), "ended": [], "written": 0}
        mark = F.coalesce(F.col(end), F.lit(False)) if end else F.lit(False)
        real = fresh.where(F.col(source).isin(list(weights)))
        found = real.groupBy(source).agg(F.count_if(~mark).alias("n"), F.bool_or(mark).alias("over")).collect()  # a row a source of the configuration
        seen = before["seen"] | {r[0]: before["seen"][r[0]] + r.n for r in found}
        ended = sorted({*before["ended"], *(r[0] for r in found if r.over)})
        stretches = phases({s: seen[s] if s in ended else None for s in weights}, weights)
        missing = [p.place(s, seen[s]) for p in stretches for s in p.slots if s not in ended and seen[s] >= p.taken[s]]
        ready = min(missing, default=sum(seen.values()))
        start = F.create_map(*(F.lit(x) for kv in before["seen"].items() for x in kv))[F.col(source)]
        new = running(real.where(~mark), order, place="_row", by=[source]).withColumn("_row", F.col("_row") + start)
        waiting = spark.read.schema(new.schema).parquet(f"{state}/waiting-{number - 1}") if number else None
        all_ = new if waiting is None else waiting.unionByName(new)
        placed = all_.withColumn("position", _position(source, "_row", stretches))
        placed.where(F.col("position") < ready).drop("_row").write.mode("overwrite").parquet(f"{out}/batch={number}")
        placed.where(F.col("position") >= ready).drop("position").write.mode("overwrite").parquet(f"{state}/waiting-{number}")
        store.create_dir(store_of(state)[1], recursive=True)
        with store.open_output_stream(store_of(note(number))[1]) as f:
            f.write(json.dumps({"seen": seen, "ended": ended, "written": ready}).encode())

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
