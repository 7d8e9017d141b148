"""Column functions, readers, writers and streams on small inputs with known answers."""

import json
import re

import pytest
from pyspark.sql import functions as F

from plotloom.functions import numbers as N
from plotloom.functions import text as T
from plotloom.operators import metrics as M
from plotloom.operators import subtitles
from plotloom.plans.all_queries import QUERIES
from plotloom.sources import readers, writers
from plotloom.streaming import windows


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


LETTERS = {
    None: None, "": None, "  ": None, "A": "A", "b. foo": "B", "Because it was Ross": "B", "The answer is c": "C", "The answer: D": "D", "I select b": "B", "Option D seems right": "D",
    "option about it": "A", "It is (C).": "C", "Yes": None, "No": None, "Rose had a cat": "A", "Monica": None, "Phoebe": "B", "Ross": None, "I choose the first one": "C", "I choose door B": "D",
}


def test_answer_letters(spark):
    rows = spark.createDataFrame([(k, v) for k, v in LETTERS.items()], "s string, want string")
    got = {r.s: r.x for r in rows.select("s", T.answer_letter(F.col("s")).alias("x")).collect()}
    assert got == LETTERS


def test_text(spark):
    assert one(spark, T.punctuation(F.col("s")), s="well-known") == "well known"
    assert one(spark, T.punctuation(F.col("s")), s="hello, world!") == "hello world "
    assert one(spark, T.punctuation(F.col("s")), s="1,000 (one)") == "1000 one"
    assert one(spark, T.punctuation(F.col("s")), s="3.5 m.") == "3.5 m"
    assert one(spark, T.digits_articles(F.col("s"), {"dont": "don't"}), s="The two dogs dont") == "2 dogs don't"
    assert one(spark, T.caption_clean(F.col("s")), s='A "Red" car... (fast)!\n') == "a red car fast"
    assert one(spark, T.location(F.col("s")), s="[Scene: Central Perk, everyone]") == "Central Perk"
    pairs = lambda s: [tuple(p) for p in one(spark, T.dialogue_pairs(F.col("s")), s=s)]
    assert pairs("Ross: Hi.  Rachel: Hello   there") == [("HI. RACHEL", "Hello there")]
    assert pairs("Written by: Marta") == [] and pairs("It is 10:30 now") == []
    assert one(spark, T.relabel_plain(F.array(F.col("s"))), s="Central Perk") == ["A. entral Perk"]
    assert one(spark, T.relabel_kept(F.array(F.col("s"))), s="Central Perk") == "A. Central Perk"
    assert one(spark, T.ordered_distinct(F.array(F.col("a"), F.col("b"), F.col("c"))), a="X ", b="x", c="all") == ["X "]


def test_numbers(spark):
    assert one(spark, N.from_seconds(F.col("s")), s=3723.4567) == "01:02:03.456"
    assert one(spark, N.iso_seconds(F.col("s")), s="PT1H2M3S") == 3723
    assert [one(spark, N.to_seconds(F.col("s")), s=x) for x in ("00:01:05", "", "00:00:05.5")] == [65, 0, 0]
    assert one(spark, N.linspace(F.col("n"), 8), n=100) == [0, 14, 28, 42, 56, 70, 84, 99]
    assert one(spark, N.arange(F.col("n"), 8), n=100) == [0, 12, 25, 37, 50, 62, 75, 87]
    assert one(spark, N.segment_centres(F.col("n"), 4), n=99) == [12, 37, 62, 86]
    box = lambda *v: tuple(map(F.lit, v))
    assert abs(one(spark, N.iou(box(0, 0, 9, 9), box(5, 5, 14, 14))) - 25 / 175) < 1e-9


def test_metrics(spark):
    rows = spark.createDataFrame([("0", "0"), ("1", "1"), ("1", "-1"), ("2", "2")], "t string, p string")
    r = M.class_metrics(rows, "t", "p").first()
    assert (r.accuracy, r.precision_macro, r.recall_macro, r.f1_macro) == (0.75, 0.75, 0.625, 0.666667)
    assert (r.precision_weighted, r.recall_weighted, r.f1_weighted, r.kappa) == (1.0, 0.75, 0.833333, 0.666667)
    people = spark.createDataFrame([(1, "x" if i < 2 else f"y{i}", "x") for i in range(10)], "q int, a string, g string")
    assert M.consensus(people, "q", "a", "g").first().score == pytest.approx(0.6)


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/0101.html").write_text("<title>One</title><p>Hi <b>there</b></p><p> </p>")
    (tmp_path / "p/notes.html").write_text("<p>no</p>")
    assert [(r.stem, r.title, r.paragraphs) for r in readers.script_pages(spark, str(tmp_path / "p")).collect()] == [("0101", "One", ["Hi there"])]
    (tmp_path / "q").mkdir()
    (tmp_path / "q/a.json").write_text(json.dumps([{"question_id": "q1", "options": ["x"]}]))
    (tmp_path / "q/b.json").write_text(json.dumps({"qa_dataset": [{"question_id": "q2"}, {"question_id": "q3"}]}))
    assert sorted(r.question_id for r in readers.questions(spark, str(tmp_path / "q")).collect()) == ["q1", "q2", "q3"]
    (tmp_path / "v").mkdir()
    (tmp_path / "v/ep1.vtt").write_text("WEBVTT\n\n00:01:10.000 --> 00:01:20.500\nHello\nyou\n\n01:20.500 --> 01:30.000\nBye\n")
    cues = readers.cues(spark, str(tmp_path / "v"))
    assert [tuple(r) for r in cues.orderBy("pos").collect()] == [("ep1", 0, 70.0, 80.5, "Hello you"), ("ep1", 1, 80.5, 90.0, "Bye")]
    files = {r.file: r.vtt for r in subtitles.clip_files(cues, 80.0).collect()}
    assert files == {"0001.vtt": "WEBVTT\n\n00:01:10.000 --> 00:01:20.000\nHello you\n", "0002.vtt": "WEBVTT\n\n00:00:00.000 --> 00:00:00.500\nHello you\n\n00:00:00.500 --> 00:00:10.000\nBye\n"}
    total = spark.createDataFrame([("ep1", 250.0)], "video_id string, total double")
    assert [r.vtt for r in subtitles.clip_files(cues, 80.0, total).orderBy("file").collect()][2:] == ["WEBVTT\n", "WEBVTT\n"]
    assert subtitles.whole_vtt(cues).first().vtt.startswith("WEBVTT\n\n00:01:10.000 --> 00:01:20.500\nHello you\n\n00:01:20.500")
    (tmp_path / "k.json").write_text(json.dumps({"b": {"n": 1}, "a": {"n": 2}}))
    assert [(r.key, r.value.n) for r in readers.keyed_objects(spark, str(tmp_path / "k.json"), "struct<n:int>").orderBy("pos").collect()] == [("b", 1), ("a", 2)]
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,)], "k int")
    assert [r.k for r in writers.pending(left, right, ["k"]).collect()] == [1]


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    for i in range(3):
        events.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = windows.stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, value double")
    q = windows.segments(live, late="400 days").writeStream.outputMode("complete").format("memory").queryName("seg").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM seg").collect())) == sorted(map(tuple, windows.segments(events).collect()))
    q = windows.look_back(live, "user_id", "value").writeStream.outputMode("update").format("memory").queryName("back").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM back").count() >= events.select("user_id").distinct().count()


def test_text_clean_all_languages(spark, tmp_path):
    space = r"\s"
    caption = lambda t: " ".join(re.sub(space + "{2,}", " ", re.sub(r'[.!"()*#:;~]', " ", t.lower())).rstrip("\n").strip(" ").split(" ")[:50])
    alnum = lambda t: re.sub(space + "+", " ", re.sub(r"[^a-zA-Z0-9\s']", "", t)).strip(" ")
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs += [(10**6, "Él ÇA, größer: l'été!\u00a0\u2003x\x1c\n", None), (10**6 + 1, "", "fr"), (10**6 + 2, None, "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.caption, r.alnum) for r in QUERIES["text_clean"](spark, str(tmp_path)).collect()}
    assert got == {d: (None, None) if t is None else (caption(t), alnum(t)) for d, t, _ in docs}
