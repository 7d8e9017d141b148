"""Processors and tasks by name; an endless stream of a table."""

import pytest
from pyspark.sql import functions as F

from plotloom.operators import tasks
from plotloom.sources.registry import REGISTRY
from plotloom.streaming import windows


def test_processors(spark):
    rows = spark.createDataFrame([('A "Red"  car... (fast)!', "The two dogs, dont")], "c string, a string")
    got = tasks.processed(rows, {"c": ["caption"], "a": ["answer"]}).first()
    assert (got.c, got.a) == ("a red car fast", "2 dogs don't")
    assert "caption" in REGISTRY.names("processor") and {"exact_match", "multiple_choice", "captioning"} <= set(REGISTRY.names("task"))
    for find in (tasks.processor, tasks.task):
        with pytest.raises(KeyError, match="there are"):
            find("none")


def test_tasks(spark):
    samples = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "y")], "question_id int, answer string, g string")
    guesses = spark.createDataFrame([(1, "a"), (1, "z"), (2, "a"), (9, "q")], "question_id int, prediction string")
    assert tuple(tasks.task("exact_match").evaluate(samples, guesses).first()) == (3, 1, 0.333333)
    assert sorted(map(tuple, tasks.task("exact_match").evaluate(samples, guesses, ["g"]).collect())) == [("x", 2, 1, 0.5), ("y", 1, 0, 0.0)]
    assert tasks.task("multiple_choice").evaluate(samples, guesses).first().accuracy == 0.333333
    assert tasks.task("captioning").evaluate(samples, guesses).first().bleu1 == 0.333333
    with pytest.raises(Exception, match="no prediction for 3"):
        tasks.task("strict_exact_match").evaluate(samples, guesses).collect()


def test_epochs(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k}") for k in (5, 1, 3)], "k int, t string")
    q = windows.epochs(rows, ["k"], 50).writeStream.format("memory").queryName("again").option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(60):
        q.processAllAvailable()
        if spark.table("again").count() > 40:
            break
    q.stop()
    got = sorted((r.epoch, r.place, r.k, r.t) for r in spark.table("again").collect())
    assert len(got) > 40 and got == [(i // 3, i % 3, (1, 3, 5)[i % 3], f"t{(1, 3, 5)[i % 3]}") for i in range(len(got))]
    assert spark.table("again").where(F.col("ts").isNull()).count() == 0
