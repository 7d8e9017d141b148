"""Connected components of an edge table, without bringing the edges to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotloom.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the component's smallest node.

    Alternates large-star and small-star steps, each a partial minimum by node and a join, until the edges no longer change; the
    number of rounds grows with the logarithm of the longest path. Each round is written to the checkpoint folder.
    """

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row.n, row.h

    now = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = mark(now)
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b").where("a < b").distinct()
        up = large.select(F.col("b").alias("a"), F.col("a").alias("b"))  # from each node to its smaller neighbours
        low = up.groupBy("a").agg(F.min("b").alias("low"))
        small = up.join(low, "a").select(F.col("low").alias("a"), F.col("b")).where("a < b").unionByName(low.select(F.col("low").alias("a"), F.col("a").alias("b"))).distinct()
        now = durable(small)
        if (found := mark(now)) == seen:
            break
        seen = found
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
