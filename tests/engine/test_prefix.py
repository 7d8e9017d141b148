"""Two-level scans against plain windows and loops."""

import random

from pyspark.sql import functions as F

from plotloom.operators import prefix


def test_running(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "hot", "hot", "hot", "a", f"g{i % 40}"]), rng.choice([None, 1, 2, 3]) if i % 5 else i, i, rng.choice([None, 1.5, -2.0, 3.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, t int, k int, v double").repartition(5)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for by in ((), ("g",)):
        got = prefix.running(df, ["t", "k"], {"total": F.col("v"), "ones": F.lit(1)}, "at", "all", by, buckets=16, sample=900)
        assert got.columns == ["g", "t", "k", "v", "total", "ones", "at", "all"]
        groups = {}
        for r in rows:
            groups.setdefault(r[0] if by else 0, []).append(r)
        want = {}
        for own in groups.values():
            total = None
            for i, r in enumerate(sorted(own, key=order)):
                total = total if r[3] is None else (total or 0) + r[3]
                want[r[2]] = (total, i + 1, i, len(own))
        assert {r.k: (r.total, r.ones, r["at"], r["all"]) for r in got.collect()} == want
    assert prefix.running(df.limit(0), ["k"], place="at").count() == 0
    parts = prefix.even_parts(df, 7, ["t", "k"], by=["g"]).groupBy("g", "part").count().collect()
    for g in groups:
        sizes = [r["count"] for r in sorted((r for r in parts if r.g == g), key=lambda r: r.part)]
        assert sizes == [len(groups[g]) // 7 + (i < len(groups[g]) % 7) for i in range(7)][: len(sizes)] and sum(sizes) == len(groups[g])


def test_no_bucket_is_large(spark):
    """One group with nearly all rows is dealt to buckets like any other."""
    df = spark.range(100_000).selectExpr("id", "CASE WHEN id % 50 = 0 THEN 'rare' ELSE 'hot' END AS g")
    sizes = [r["count"] for r in prefix.bucketed(df, ["g", "id"], 64).groupBy("_bucket").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 3 * 100_000 / 64
    plan = prefix.running(df, ["id"], place="at", by=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert all("_bucket" in line for line in plan.splitlines() if "Exchange hashpartitioning(_group" not in line and "Exchange hashpartitioning" in line)
