"""The result store under writers at once, killed writers and repeated batches; merged states against one pass."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotloom.operators import metrics, states
from plotloom.sources.commits import Part, ResultStore


def rows_of(spark, values):
    return spark.createDataFrame(values, "k string, rank int, v string")


def test_commits(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "s"))
    assert store.read() is None and store.versions() == []
    assert store.append(rows_of(spark, [("a", 1, "late"), ("a", 0, "first"), ("b", 0, "x")]), "run1", ["k"], ["rank"]) == 1
    assert store.append(rows_of(spark, [("b", 0, "again"), ("c", 0, "y")]), "run2", ["k"], ["rank"]) == 2
    assert store.append(rows_of(spark, [("d", 0, "z")]), "run2", ["k"], ["rank"]) is None  # a repeated batch
    assert sorted((r.k, r.v) for r in store.read().collect()) == [("a", "first"), ("b", "x"), ("c", "y")]
    assert sorted(r.k for r in store.read(1).collect()) == ["a", "b"]
    store._stage(rows_of(spark, [("e", 0, "killed before its commit")]))
    held = f"{tmp_path}/s/commits/.held"
    open(held, "w").write("{")  # and one killed while it wrote its manifest
    assert store.read().count() == 3 and store.versions() == [1, 2]
    assert len(store.tidy()) == 1 and store.read().count() == 3
    assert store.compact() == 3 and len([p for p in store.parts() if p.folder]) == 1 and store.read().count() == 3
    assert store.append(rows_of(spark, [("q", 0, "q")]), "run1", ["k"], ["rank"]) is None  # batches stay known
    assert store.append(rows_of(spark, [("q", 0, "q")]), "run3") == 4 and store.read().count() == 4
    assert store.append(rows_of(spark, []), "run4", ["k"], ["rank"]) == 5 and store.read().count() == 4
    assert not store._create(5, [Part("data/none", None)])  # a version is made once


def test_writers_at_once(spark, tmp_path):
    """Six writers with keys in common, two of them of one batch: every key once, every batch once."""
    folder = str(tmp_path / "s")
    sets = [[(f"k{j}", i, f"w{i}") for j in range(i * 5, i * 5 + 10)] for i in range(5)]

    def write(i):
        return ResultStore(spark, folder).append(rows_of(spark, sets[min(i, 4)]), f"b{min(i, 4)}", ["k"], ["rank"])

    with ThreadPoolExecutor(6) as pool:
        made = list(pool.map(write, range(6)))
    assert sorted(m for m in made if m) == [1, 2, 3, 4, 5] and made.count(None) == 1
    got = [r.k for r in ResultStore(spark, folder).read().collect()]
    assert sorted(got) == sorted({k for s in sets for k, _, _ in s}) and len(got) == len(set(got))


def test_merged_states(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(int(i % 4), str(rng.integers(0, 3)), str(rng.integers(0, 3)), 1e9 + float(rng.normal()), None if i % 5 else float(i)) for i in range(900)]
    rows = spark.createDataFrame(data, "g int, t string, p string, v double, w double")
    store, moments = ResultStore(spark, str(tmp_path / "c")), ResultStore(spark, str(tmp_path / "m"))
    for part in range(3):
        own = rows.where(F.pmod(F.xxhash64("v"), F.lit(3)) == part)
        for _ in range(2):  # the second is the same batch, and counts once
            store.append(states.confusion_state(own, "t", "p", ["g"]), f"part{part}")
            moments.append(states.moment_state(own, ["v", "w"], ["g"]), f"part{part}")
    want = {r.g: r for r in metrics.class_metrics(rows, "t", "p", ["g"]).collect()}
    assert {r.g: r for r in states.confusion_scores(store.read(), ["g"]).collect()} == want
    for r in states.moment_scores(moments.read(), ["g"], 9).collect():
        own = np.array([x[3 if r.value == "v" else 4] for x in data if x[0] == r.g and x[3 if r.value == "v" else 4] is not None])
        assert r.n == len(own) and r.mean == pytest.approx(own.mean(), abs=1e-6) and r.deviation == pytest.approx(own.std(), rel=1e-6) and (r.low, r.high) == (own.min(), own.max())
    halves = [states.sum_state(rows.where(F.col("g") % 2 == k), ["v"], ["g"]) for k in (0, 1)]
    assert states.merged_sums(halves, ["v"]).count() == 1 and states.merged_sums(halves, ["v"], ["g"]).count() == 4
