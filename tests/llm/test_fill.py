"""Fill-in-middle against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from plotloom.llm import fill_middle

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
LONG = "the quick brown fox\n jumps " * 9000 + "é漢" * 3000 + " tail \n"
TEXTS = [None, "", " ", "\n\t \x0b", "one", " one two  three\n\nfour ", "a <P> b c", "ends in <S>", "<M>", "x<S y P>z <", "é 漢字   \U0001f600 z\x00y", LONG, "> < P S M " * 50]


def brute(doc_id, text, rate=50, spm=80, seed=42):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return doc_id, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


@pytest.mark.parametrize(("rate", "spm", "hot"), [(50, 80, 16_384), (100, 50, 7)])
def test_fill(spark, rate, spm, hot):
    rows = [(i if i % 11 else None, TEXTS[i % len(TEXTS)]) for i in range(400)] + [(5, "same id and text"), (5, "same id and text"), (-3, "a b c"), (2**62, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS run", "3 AS docs", "4 AS parts", "5 AS `output`")
    got = Counter(tuple(r) for r in fill_middle.digests(fill_middle.fill_in_middle(df, rate, spm, hot=hot)).collect())
    assert got == Counter(brute(d, t, rate, spm) for d, t in rows)
    assert {"plain", "spm", "psm"} == {r[2] for r in got}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_groups_are_verified(spark):
    texts = spark.createDataFrame([(b"a", "x y"), (b"a", "x y"), (b"b", "z")], "key binary, text string")
    assert sorted((bytes(r.key), r.docs, r.text) for r in fill_middle.text_groups(texts).collect()) == [(b"a", 2, "x y"), (b"b", 1, "z")]
    with pytest.raises(Exception, match="same key"):
        fill_middle.text_groups(texts.union(spark.createDataFrame([(b"b", "other")], texts.schema))).collect()


def test_texts_travel_once(spark):
    """All uses of the grouped texts read one exchange, and only lists go through another."""
    df = spark.createDataFrame([(i, f"a b {i % 7}") for i in range(50)], "doc_id long, text string")
    found = fill_middle.fill_in_middle(df, hot=5)
    assert found.count() == 50
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    assert len(re.findall(r"Exchange .*\n.*partial_collect_set", final)) <= 1
    assert not re.search(r"Exchange hashpartitioning\(key#\d+, \d+\).*\n[^\n]*Project \[key#\d+, text#", final)


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, most in ((1, 1), (1, 10**6), (7, 7), (500, 600), (3000, 10**9), (64, 64), (1000, 0)):
        values = np.sort(rng.integers(0, most + 1, n))
        own = fill_middle.EliasFano.load(fill_middle.EliasFano.of(values).dump())
        assert own.select(range(n)) == values.tolist()
        assert 8 * (len(own.low) + len(own.high)) <= n * (own.bits + 3) + 136
    assert fill_middle.EliasFano.load(fill_middle.EliasFano.of(values[:0]).dump()).n == 0
