"""The consensus of answers against a plain loop."""

import random
import time

from plotloom.functions import text as T
from plotloom.operators import vqa


def test_consensus_of_many_answers(spark):
    """Repeated answers, missing ids and answers, and a question with so many that each must not be worked out for each other."""
    rng = random.Random(1)
    answers = lambda n, odd: [(rng.choice([None, *range(n)]) if odd else i, rng.choice(["cat", "Cat", "two", "a, b", None] if odd else ["cat", "dog."])) for i in range(n)]
    rows = [(k, rng.choice(["cat", "Cat\n", "two", "a b"]), answers(rng.randint(1, 9), True)) for k in range(200)] + [(1000, "cat", answers(3000, False))]
    df = spark.createDataFrame(rows, "k int, guess string, answers array<struct<answer_id:int,answer:string>>")
    began = time.time()
    got = {r.k: r.score for r in df.select("k", vqa.consensus_score(df.guess, df.answers).alias("score")).collect()}
    assert time.time() - began < 60
    words = spark.createDataFrame([(r[1],) for r in rows], "t string").distinct()
    plain = {r.t: r.p for r in words.select("t", T.digits_articles(T.punctuation(T.strip(words.t))).alias("p")).collect()}
    marked = spark.createDataFrame([(a,) for a in ("cat", "Cat", "two", "a, b", "dog.")], "t string")
    kept = {r.t: r.p for r in marked.select("t", T.punctuation(marked.t).alias("p")).collect()} | {None: None}
    for k, guess, own in rows:
        held = [(i, kept[a]) for i, a in own] if len({a for _, a in own}) > 1 else own
        want = plain.get(guess, plain.get(guess.strip()))
        fit = [b for b in held if b[1] == want]
        scores = [min(1.0, sum(b != a for b in fit) / 3) for a in held]
        assert abs(got[k] - sum(scores) / len(scores)) < 1e-9, (k, guess, own)
