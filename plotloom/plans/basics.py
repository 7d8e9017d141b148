"""Queries of small operators: numbers of letters, joins of captions, histograms, groups, slices, identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotloom.functions import media as X
from plotloom.functions import text as T
from plotloom.operators import models as M
from plotloom.operators import relate as R
from plotloom.operators import stories as S
from plotloom.plans.registry import query
from plotloom.plans.stories import story_events


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE (event_id % 26)::INT END AS number FROM events")
def letter_numbers(t):
    e = F.col("event_id")
    letter = F.when(e % 5 == 0, F.when(e % 2 == 0, "").otherwise("AB")).otherwise(F.char((e % 26 + 65).cast("int")))
    return t("events").select("event_id", T.letter_index(letter).cast("int").alias("number"))


@query("WITH c AS (SELECT o_custkey image_id, arg_max(o_orderpriority, o_orderkey) AS caption FROM orders GROUP BY 1) SELECT c_custkey question_id, caption FROM customer JOIN c ON c.image_id = c_custkey WHERE c_custkey % 3 = 0")
def captioned_questions(t):
    captions = R.last_by(t("orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderpriority").alias("caption"), "o_orderkey"), ["image_id"], "caption", "o_orderkey")
    asked = t("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("question_id"), F.col("c_custkey").alias("image_id"))
    return asked.join(captions, "image_id").select("question_id", "caption")


@query("""WITH q AS (SELECT event_type t, 's' || event_id % 3 s, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'E+S' END c, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'L' ELSE 'S' END g, event_id % 3 e, event_id % 2 k, (event_id % 6 - 1)::INT a FROM events)
SELECT 'question_type' AS kind, t AS name, count(*) n FROM q GROUP BY 2 UNION ALL SELECT 'subcategory', s, count(*) FROM q GROUP BY 2 UNION ALL SELECT 'cue', c || ' -> ' || g, count(*) FROM q WHERE c <> '' GROUP BY 2 UNION ALL SELECT 'target', g, count(*) FROM q WHERE g <> '' GROUP BY 2
UNION ALL SELECT 'episode_span', e || ' episode(s)', count(*) FROM q WHERE e > 0 GROUP BY 2 UNION ALL SELECT 'clip_span', k || ' clip(s)', count(*) FROM q WHERE k > 0 GROUP BY 2 UNION ALL SELECT 'answer', chr(65 + a), count(*) FROM q WHERE a BETWEEN 0 AND 3 GROUP BY 2 UNION ALL SELECT 'total', 'total_questions', count(*) FROM q""")
def question_histograms(t):
    e = F.col("event_id")
    rows = t("events").select(
        F.col("event_type").alias("question_type"), F.concat(F.lit("s"), e % 3).alias("subcategory"), F.when(e % 4 == 0, "").otherwise("E+S").alias("cues"), F.when(e % 5 == 0, "").when(e % 5 == 1, "L").otherwise("S").alias("target"),
        F.array_repeat(F.lit("x"), (e % 3).cast("int")).alias("episode_span"), F.array_repeat(F.lit("y"), (e % 2).cast("int")).alias("clip_span"), (e % 6 - 1).cast("int").alias("answer_index"),
    )
    return S.question_statistics(rows)


@query("""WITH e AS (SELECT strftime(ts, '%m%d') episode, strftime(ts, '%m%d') || '_scene_' || lpad(hour(ts)::VARCHAR, 3, '0') || '_event_' || lpad(event_id::VARCHAR, 9, '0') event_id, CASE WHEN event_id % 37 = 0 THEN '' WHEN value > 200 THEN 'unknown room' ELSE event_type || CASE WHEN user_id % 3 = 0 THEN ' Hall' ELSE ' Bar' END END AS location FROM events)
SELECT episode, location, count(*) n, min(event_id) AS first, max(event_id) AS last, md5(string_agg(event_id, ',' ORDER BY event_id)) ids FROM e WHERE location <> '' GROUP BY ALL""")
def location_groups(t):
    rows = S.by_location(story_events(t))
    ids = F.transform("events", lambda x: x["event_id"])
    return rows.select("episode", "location", F.size("events").cast("long").alias("n"), F.get(ids, 0).alias("first"), F.element_at(ids, -1).alias("last"), F.md5(F.array_join(ids, ",")).alias("ids"))


@query("SELECT c_custkey image_id, count(*) captions, count(DISTINCT o_orderpriority) kinds FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 UNION ALL SELECT NULL, count(*), 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def captioned_strokes(t):
    strokes = t("customer").select(F.col("c_custkey").alias("image_id"))
    captions = t("orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderpriority").alias("caption"))
    both, lone = R.grouped_join(strokes, captions, "image_id", "caption")
    counts = both.select("image_id", F.size("caption").cast("long").alias("captions"), F.size(F.array_distinct("caption")).cast("long").alias("kinds"))
    return counts.unionByName(lone.agg(F.count("*").alias("captions")).select(F.lit(None).cast("long").alias("image_id"), "captions", F.lit(0).cast("long").alias("kinds")))


@query("SELECT l_orderkey, round(sum(l_quantity), 2) score, max(o_orderstatus) truth, count(*) FILTER (o_orderkey IS NULL) unmatched FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def scores_by_id(t):
    truth = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("truth"))
    scores = t("lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("score"), F.count("*").alias("n"))
    return scores.join(truth, "l_orderkey", "left").select("l_orderkey", "score", "truth", F.when(F.col("truth").isNull(), F.col("n")).otherwise(0).cast("long").alias("unmatched"))


@query("WITH s AS (SELECT conv_id, turn, len(string_split(text, ' ')) n FROM conversations) SELECT conv_id, count(*) scenes, sum(n)::BIGINT events, round(avg(n), 6) average FROM s GROUP BY 1")
def events_per_scene(t):
    scenes = t("conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.split("text", " ").alias("events"))).alias("scenes"))
    size = lambda s: F.size(s["events"]).cast("long")
    total = F.aggregate(F.transform("scenes", size), F.lit(0).cast("long"), lambda a, x: a + x)
    return scenes.select("conv_id", F.size("scenes").cast("long").alias("scenes"), total.alias("events"), F.round(F.try_divide(total, F.size("scenes")), 6).alias("average"))


@query("""WITH t AS (SELECT conv_id, list(text ORDER BY turn) x, string_agg(text, ' ' ORDER BY turn) j FROM conversations GROUP BY 1) SELECT conv_id, array_to_string(x[1:3], '|') head, array_to_string(x[greatest(1, len(x) - 2):], '|') AS tail, x[1] AS first, array_to_string(string_split(j, ' ')[1:50], ' ') words, array_to_string(string_split(j, ' ')[greatest(1, len(string_split(j, ' ')) - 9):], ' ') AS last FROM t""")
def slices(t):
    x = F.transform("x", lambda v: v["text"])
    held = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x")).select("conv_id", x.alias("x"), F.array_join(x, " ").alias("j"))
    n = F.least(F.size("x"), F.lit(3))
    return held.select("conv_id", F.array_join(F.slice("x", 1, 3), "|").alias("head"), F.array_join(F.slice("x", F.size("x") - n + 1, n), "|").alias("tail"), F.get("x", 0).alias("first"), F.array_join(F.slice(F.split("j", " "), 1, 50), " ").alias("words"), X.last_words(F.col("j"), 10).alias("last"))


@query("SELECT 'first' AS part, doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 7) UNION ALL SELECT 'rest', doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id OFFSET 20)")
def prefix_and_offset(t):
    d = R.in_order(t("documents").select("doc_id"), "doc_id", "at")
    return d.where("at < 7").select(F.lit("first").alias("part"), "doc_id").unionByName(d.where("at >= 20").select(F.lit("rest").alias("part"), "doc_id"))


@query("SELECT p_partkey, CASE WHEN length(p_partkey::VARCHAR) < 3 THEN lpad(p_partkey::VARCHAR, 3, '0') ELSE p_partkey::VARCHAR END AS short, string_split(p_brand, '#')[2] AS number, p_name[1:2] AS head, upper(p_name[1:1]) || p_name[2:] AS title, CASE WHEN p_size % 2 = 0 THEN 'k' ELSE 'model' || p_size END AS key, CASE WHEN p_size % 2 = 0 THEN '/m=' || p_size END AS path FROM part")
def identifiers(t):
    k = F.col("p_partkey")
    pair = T.override(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("k=/m="), "p_size")).otherwise(F.concat(F.lit("model"), "p_size")))
    return t("part").select("p_partkey", T.padded_id(k, 3).alias("short"), F.get(F.split("p_brand", "#"), 1).alias("number"), F.substring("p_name", 1, 2).alias("head"), F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 10_000)).alias("title"), pair["key"].alias("key"), pair["path"].alias("path"))


@query("SELECT doc_id, (n_chars * 2)::BIGINT a, array_to_string([n_chars * 2, (n_chars + 1) * 2], ',') b FROM documents")
def mapped_leaves(t):
    twice = lambda x: x * 2
    tree = F.create_map(F.lit("a"), F.array("n_chars"), F.lit("b"), F.array(F.col("n_chars"), F.col("n_chars") + 1))
    out = R.on_leaves(tree, twice)
    return t("documents").select("doc_id", F.get(out["a"], 0).alias("a"), F.array_join(out["b"], ",").alias("b"))


@query("SELECT p_partkey, array_to_string(list_transform(range(32), lambda i: (((p_size >> (i % 6)::INT) & 1) <> ((p_partkey >> (i % 11)::INT) & 1))::INT), '') AS only_one FROM part")
def mask_differences(t):
    """Masks of 32 points, of the bits of a size and of a key: where exactly one of them is set."""
    points = F.sequence(F.lit(0), F.lit(31))
    bit = lambda value, wide: F.transform(points, lambda i: F.call_function("shiftright", value, (i % wide).cast("int")).bitwiseAND(F.lit(1)).cast("int"))
    out = M.masked_difference(bit(F.col("p_size").cast("long"), 6), bit(F.col("p_partkey").cast("long"), 11))
    return t("part").select("p_partkey", F.array_join(F.transform(out, lambda x: x.cast("string")), "").alias("only_one"))
