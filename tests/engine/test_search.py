"""Exact nearest neighbours in blocks against brute force."""

import numpy as np
import pytest

from plotloom.operators import relate


def brute(queries, docs, k):
    out = {}
    for q, v in queries:
        rows = []
        for d, w in docs:
            if d != q and len(w) == len(v) and len(v):
                a, b = np.array(v, float), np.array(w, float)
                length = np.sqrt((a * a).sum() * (b * b).sum())
                rows.append((d, None if not length else float((a * b).sum() / length)))
        rows.sort(key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        out.update({(q, i + 1): r for i, r in enumerate(rows[:k])})
    return out


def frames(spark, queries, docs):
    return spark.createDataFrame(queries, "query_id long, v array<double>"), spark.createDataFrame(docs, "doc_id long, v array<double>")


def same(got, want):
    found = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in got.collect()}
    assert found.keys() == want.keys()
    for key, (d, score) in want.items():
        assert (found[key][1] is None) == (score is None)
        assert score is None or abs(found[key][1] - score) < 1e-9
        assert found[key][0] == d or abs(found[key][1] - score) < 1e-12


@pytest.mark.parametrize("k", [1, 5, 60])
def test_pruned_equals_brute(spark, k):
    rng = np.random.default_rng(k)
    middles = rng.normal(size=(20, 16))
    docs = [(i, (middles[i % 20] + 0.15 * rng.normal(size=16)).tolist()) for i in range(1500)]
    docs += [(2000 + i, docs[3][1]) for i in range(70)] + [(3000 + i, rng.normal(size=5).tolist()) for i in range(4)] + [(4000, [0.0] * 16), (4001, [0.0] * 16), (4002, [])]
    queries = [*docs[:60], (2005, docs[3][1]), (3001, docs[-6][1]), (4000, [0.0] * 16), (5000, rng.normal(size=16).tolist()), (5001, []), (5002, [1.0] * 7)]
    left, right = frames(spark, queries, docs)
    want = brute(queries, docs, k)
    rows, met = relate.pruned_cosine(left, right, k, held=40, asked=16)
    same(rows, want)
    same(relate.top_cosine(left, right, k, asked=16, held=100), want)
    assert met["met"] <= met["pairs"]


def test_clustered_vectors_meet_few_blocks(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(100, 24))
    docs = [(i, (middles[i % 100] + 0.1 * rng.normal(size=24)).tolist()) for i in range(8000)]
    left, right = frames(spark, docs[:400], docs)
    rows, met = relate.pruned_cosine(left, right, 10, held=100)
    assert met["met"] < met["pairs"] / 3, met
    same(rows, brute(docs[:400], docs, 10))


def test_blocks_meet_in_many_partitions(spark):
    rng = np.random.default_rng(3)
    docs = [(i, rng.normal(size=16).tolist()) for i in range(900)]
    docs += [(1000 + i, docs[i % 30][1]) for i in range(300)]  # copies: ties go to the smaller doc_id
    left, right = frames(spark, docs[:90], docs)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small groups are brought to one partition
    try:
        got = {(r.query_id, r["rank"]): r.doc_id for r in relate.top_cosine(left, right, 12, asked=16, held=100).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    unit = np.array([v for _, v in docs])
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    ids = np.array([d for d, _ in docs])
    for q, line in enumerate([[(u * v).cumsum()[-1] for u in unit] for v in unit[:90]]):
        order = sorted((-s, d) for s, d in zip(line, ids, strict=True) if d != q)[:12]
        assert [got[q, i + 1] for i in range(12)] == [d for _, d in order]
