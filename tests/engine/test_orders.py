"""Shuffle buffers and weighted interleaving against their bounds and a plain loop."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plotloom.operators import orders
from plotloom.sources.scratch import scratch


@pytest.mark.parametrize("buffer", [1, 7, 100, 5000])
def test_shuffle_buffer(spark, buffer):
    rows = spark.range(3000, numPartitions=3).selectExpr("id", "concat('t', id) AS text")
    got = orders.shuffle_buffer(rows, buffer, seed=3, epochs=2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, orders.shuffle_buffer(rows, buffer, seed=3, epochs=2).collect()))
    for epoch in range(2):
        own = [r for r in got if r.epoch == epoch]
        assert sorted(r.id for r in own) == list(range(3000)) and all(r.text == f"t{r.id}" for r in own)
        for part in range(3):
            line = [r.id for r in sorted((r for r in own if r.part == part), key=lambda r: r.place)]
            moved = [abs(place - (i - part * 1000)) for place, i in enumerate(line)]
            assert max(moved) < buffer and (buffer == 1 or sum(moved) / 1000 > min(buffer, 1000) / 10)
    assert buffer == 1 or [r.place for r in sorted(got, key=lambda r: (r.epoch, r.id))][:3000] != [r.place for r in sorted(got, key=lambda r: (r.epoch, r.id))][3000:]
    assert orders.shuffle_buffer(rows.limit(0), buffer).count() == 0


def held(line, weights, sizes):
    """Each source is within one row of its share of what the phase has given so far, and its rows come in order; sources that ended have no share."""
    taken, base, start = Counter(), Counter(), 0
    for n, (source, row) in enumerate(line):
        assert row == taken[source]
        active = [s for s in weights if weights[s] and base[s] < sizes[s]]
        taken[source] += 1
        total = sum(weights[s] for s in active)
        for s in active:
            assert abs(taken[s] - base[s] - (n + 1 - start) * weights[s] / total) < 1 + 1e-9
        if taken[source] == sizes[source]:
            base, start = Counter(taken), n + 1


@pytest.mark.parametrize(("weights", "sizes"), [({"a": 3, "b": 1, "c": 2}, {"a": 300, "b": 10, "c": 77}), ({"a": 50, "b": 7, "c": 1, "d": 1, "e": 13}, {"a": 90, "b": 200, "c": 30, "d": 1, "e": 0}), ({"a": 4, "b": 2}, {"a": 5, "b": 900}), ({"a": 1}, {"a": 3})])
def test_interleaved(spark, weights, sizes):
    rows = [(s, i) for s, n in sizes.items() for i in range(n)] + [("other", 0)]
    random.Random(1).shuffle(rows)
    got = orders.interleaved(spark.createDataFrame(rows, "s string, i int"), "s", ["i"], weights).collect()
    assert sorted(r.position for r in got) == list(range(sum(sizes.values())))
    held([(r.s, r.i) for r in sorted(got, key=lambda r: r.position)], weights, sizes)


def test_interleaved_stream(spark):
    """Batches of uneven sources: what is written is always whole so far, and in the end what a table would give."""
    weights, sizes = {"a": 3, "b": 1, "c": 2}, {"a": 120, "b": 25, "c": 60}
    rng = random.Random(4)
    place = scratch(spark, "mix")
    left, counts = dict.fromkeys(sizes, 0), []
    for k in range(6):
        some = [(s, i, False) for s in sizes for i in range(left[s], min(sizes[s], left[s] + rng.randint(0, 60) if k < 5 else sizes[s]))]
        left = {s: max([left[s], *(i + 1 for x, i, _ in some if x == s)]) for s in sizes}
        some += [("b", -1, True)] if left["b"] == sizes["b"] and k == 3 else []
        some += [(s, -1, True) for s in sizes] if k == 5 else []
        spark.createDataFrame(some, "s string, i int, over boolean").coalesce(1).write.mode("append").parquet(f"{place}/in")
        live = spark.readStream.schema("s string, i int, over boolean").parquet(f"{place}/in")
        orders.interleave_stream(live, "s", ["i"], weights, f"{place}/out", f"{place}/state", f"{place}/check", end="over").awaitTermination()
        counts.append(sorted((r.position, r.s, r.i) for r in spark.read.parquet(f"{place}/out").collect()))
        assert [p for p, _, _ in counts[-1]] == list(range(len(counts[-1])))
    assert all(a == b[: len(a)] for a, b in zip(counts, counts[1:], strict=False)) and len({len(c) for c in counts}) > 2
    assert len(counts[-1]) == sum(sizes.values())
    held([(s, i) for _, s, i in counts[-1]], weights, sizes)
    by = defaultdict(list)
    for _, s, i in counts[-1]:
        by[s].append(i)
    assert all(v == sorted(v) for v in by.values())
    assert spark.read.parquet(f"{place}/state/waiting-5").where(F.col("i") >= 0).count() == 0


def test_interleaved_documents(spark):
    from plotloom.plans.all_queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("source IN ('src0', 'src1', 'src2')").orderBy("doc_id").collect()
    place = Counter()
    number = {}
    for r in docs:
        number[r.doc_id] = place[r.source]
        place[r.source] += 1
    got = sorted(QUERIES["interleaved_documents"](spark, "/root/testdata/sf0.01").collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(docs)))
    held([(r.source, number[r.doc_id]) for r in got], {"src0": 3, "src1": 1, "src2": 2}, place)
