"""Look-back state by buckets of keys against a plain loop."""

import math
import random
from collections import defaultdict
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotloom.sources.scratch import scratch
from plotloom.streaming import windows


class Held:
    """A list or value state in memory; counts the calls."""

    def __init__(self, calls):
        self.rows, self.calls = [], calls

    def _called(self, rows):
        self.calls.append(1)
        self.rows = rows

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows) if self.is_list else self.rows[0]

    def appendValue(self, row):
        self._called([*self.rows, row])

    def put(self, rows):
        self._called(list(rows))

    def update(self, row):
        self._called([row])

    def clear(self):
        self._called([])


def framed(rows, keep, forget):
    """{id: (key, at, n, median, mean, highest, latest)} of rows (key, at, id, value), value by value."""
    out, held = {}, defaultdict(list)
    for key, at, number, value in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        own = held[key]
        if own and at > 1000 * (-(-own[-1][0] // 1000) + forget):
            own.clear()
        own.append((at, value))
        del own[:-keep]
        some = sorted(v for _, v in own if v is not None)
        out[number] = (key, at, len(own), some[(len(some) - 1) // 2] if some else None, round(sum(some) / len(some), 9) if some else None, some[-1] if some else None, value)
    return out


def none(x):
    return None if pd.isna(x) else x


@pytest.mark.parametrize("keep", [1, 3, 20])
def test_a_bucket_needs_few_state_calls(keep):
    draw = random.Random(keep)
    rows = [(draw.choice([None, *range(300)]), draw.randrange(4_000_000), i, draw.choice([None, *range(50)])) for i in range(5000)]
    forget = 400  # ms, as gaps between a key's rows often are
    calls, timers, got, most = [], set(), [], 0
    one = windows.LookBack(keep, forget)
    lists, values = Held(calls), Held(calls)
    lists.is_list, values.is_list = True, False
    one.init(SimpleNamespace(getListState=lambda *a: lists, getValueState=lambda *a: values, registerTimer=lambda ms: timers.add(ms)))
    for batch in range(5):  # batch b brings a million microseconds, a fifth of them a batch late; the watermark is two batches behind
        own = [r for r in rows if min(4, r[1] // 1_000_000 + (r[2] % 5 == 0)) == batch]
        fresh = pd.DataFrame([(int(k is None), k or 0, a, i, v) for k, a, i, v in own], columns=["none", "key", "at", "id", "value"]).astype({"value": float})
        calls.clear()
        assert list(one.handleInputRows((0,), iter([fresh]), None)) == []
        most = max(most, len(calls))
        mark = 1000 * (batch - 1) if batch < 4 else 10**6
        while due := sorted(t for t in timers if t <= mark):
            timers.discard(due[0])
            calls.clear()
            got.extend(r for f in one.handleExpiredTimer((0,), None, SimpleNamespace(getExpiryTimeInMs=lambda t=due[0]: t)) for r in f.itertuples(index=False))
            most = max(most, len(calls))
    want = framed(rows, keep, forget)
    assert len(got) == len(want) == 5000 and most <= 3
    assert {r.id: (none(r.key), r.at, r.n, none(r.median), none(round(r.mean, 9)), none(r.highest), none(r.latest)) for r in got} == want
    assert not lists.rows and not values.rows  # all keys are forgotten in the end
    with pytest.raises(ValueError):
        one.handleInputRows((0,), iter([fresh.assign(id=float("nan"))]), None)


def test_stream_with_null_keys_and_values(spark):
    """A batch of several files at a time; one key is null, and so are some values."""
    rows = spark.range(400).select(F.col("id").alias("event_id"), F.timestamp_seconds(1000 + F.col("id") * 37 % 400).alias("ts"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("user_id"), F.when(F.col("id") % 7 > 0, (F.col("id") * 11 % 50).cast("double")).alias("value"))
    place = scratch(spark, "back")
    rows.repartition(3).write.parquet(f"{place}/in")
    spark.sql("SELECT -1L AS event_id, timestamp'2100-01-01' AS ts, -1L AS user_id, 0D AS value").write.mode("append").parquet(f"{place}/in")
    live = windows.stream(windows.timed_session(spark), f"{place}/in", "event_id long, ts timestamp, user_id long, value double", 3)
    out = windows.rows_in_order(live, "user_id", "event_id", "value", keep=4, late="1 hour", buckets=2)
    out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start().awaitTermination()
    got = {r.id: (r.key, r.us, r.n, r.median, None if r.mean is None else round(r.mean, 9), r.highest, r.latest) for r in spark.read.parquet(f"{place}/out").where("id >= 0").withColumn("us", F.unix_micros("ts")).collect()}
    held = [(r.user_id, r.at, r.event_id, r.value) for r in rows.withColumn("at", F.unix_micros("ts")).collect()]
    assert len(got) == 400 and got == framed(held, 4, math.inf)
