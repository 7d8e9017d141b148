"""Caption cleaning against a plain form, in one pass over a text."""

import random
import re

from pyspark.sql import functions as F

from plotloom.functions import text as T

BLANKS = [chr(i) for i in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def plain(text, words):
    low = re.sub(r"[.!\"()*#:;~]", " ", text.lower())
    low = re.sub("[" + "".join(BLANKS) + "]{2,}", " ", low).rstrip("\n").strip(" ")
    return " ".join(low.split(" ")[:words])


def test_captions_in_one_pass(spark):
    draw = random.Random(7)
    some = [*BLANKS, *'.!"()*#:;~', *"abCD-{&\\[^$", "\r\n", "​", "、", "‧", "\U0001f600", *"xyz" * 12]
    texts = ["".join(draw.choice(some) for _ in range(draw.choice((0, 1, 2, 3, 6, 20, 90)))) for _ in range(20000)] + ["w " * 80, "a.b " * 60]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string")
    for words in (50, 2):
        got = dict(map(tuple, rows.select("i", T.caption_clean(F.col("s"), words)).collect()))
        assert [(x, got[i]) for i, x in enumerate(texts) if got[i] != plain(x, words)] == []
    got = dict(map(tuple, rows.select("i", T.strip(F.col("s"))).collect()))
    assert all(got[i] == x.strip("".join(BLANKS)) for i, x in enumerate(texts))
    plan = rows.select(T.caption_clean(F.col("s")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "split(" not in plan  # each pass decodes and copies the whole text
    assert rows.limit(1).select(T.caption_clean(F.lit(None).cast("string")).alias("c")).first().c is None
