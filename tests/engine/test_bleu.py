"""Caption scores stay where their texts lie."""

from pyspark.sql import functions as F

from plotloom.operators import vqa


def test_ngrams_are_not_shuffled(spark):
    rows = [(k, w) for k in range(30) for w in ("a b c d e a b", "a b c d x a b", "")[: 1 + k % 3]]
    pairs = spark.createDataFrame(rows, "k long, t string").groupBy("k").agg(F.min("t").alias("guess"), F.max("t").alias("reference"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = vqa.sentence_bleu(pairs, "k")
        plan = scores._jdf.queryExecution().sparkPlan().toString() + scores._jdf.queryExecution().executedPlan().toString()
        got = {r.k: r.bleu1 for r in scores.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all(line.partition("hashpartitioning(")[2].count("#") == 1 for line in exchanges)
    assert all(abs(got[k] - (1.0, 6 / 7, 0.0)[k % 3]) < 1e-9 for k in got)
