"""The near-duplicate stage sends texts once to tell kept rows apart."""

from pyspark.sql import functions as F

from plotloom.llm import simhash


def test_kept_rows_are_shuffled_once(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (1, words), (None, words), (None, "a b c d e f g"), (None, "a b c d e f g"), (0, "a b c d e f h i"), (2, None), (3, ""), (4, words + " more"), (0, "k l m n o p q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.length("text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = simhash.drop_near_duplicates(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert out.columns == ["doc_id", "text", "n"]
    assert got == sorted([(1, words, len(words)), (None, "a b c d e f g", 13), (0, "a b c d e f h i", 15), (0, "k l m n o p q", 13), (2, None, None)], key=repr)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(_kept_copy" in line]
    assert len(dealt) == 2  # both sides of the join, and not its rows again
