"""Queries of visual question answering, over parts, orders, events, labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotloom.functions import numbers as N
from plotloom.functions import text as T
from plotloom.operators import models as P
from plotloom.operators import relate as R
from plotloom.operators import vqa as V
from plotloom.plans.registry import query

_PART = "SELECT p_partkey question_id, [p_brand, p_type, p_name] choices, (p_size % 3)::INT correct_choice_idx, [p_brand, 'Brand#' || (10 + p_partkey % 45), p_brand, lower(p_brand)] direct_answers, p_partkey % 7 = 0 AS difficult_direct_answer FROM part"


def choices(t):
    k = F.col("p_partkey")
    return t("part").select(
        k.alias("question_id"), F.array("p_brand", "p_type", "p_name").alias("choices"), (F.col("p_size") % 3).alias("correct_choice_idx"),
        F.array(F.col("p_brand"), F.concat(F.lit("Brand#"), 10 + k % 45), F.col("p_brand"), F.lower("p_brand")).alias("direct_answers"), (k % 7 == 0).alias("difficult_direct_answer"),
    )


def annotations(t):
    e = F.col("event_id")
    return t("events").select(e.alias("pos"), F.col("user_id").alias("image_id"), (e % 4000).alias("question_id"), "event_type", F.concat(F.lit("q"), e % 5).alias("question_type"), F.concat(F.lit("a"), e % 3).alias("answer_type"))


@query("SELECT p_partkey, CASE WHEN lower(p_brand) = lower(trim(p_type)) THEN lower(p_brand) || ':ABC' ELSE lower(p_brand) || ':AC|' || lower(trim(p_type)) || ':B' END held FROM part")
def duplicate_options(t):
    held = V.duplicate_letters(F.array(F.col("p_brand"), F.col("p_type"), F.concat(F.lit(" "), F.upper("p_brand"))))
    return t("part").select("p_partkey", F.array_join(F.transform(held, lambda d: F.concat(d["text"], F.lit(":"), F.array_join(d["letters"], ""))), "|").alias("held"))


@query("SELECT user_id image_id, count(*) n, md5(string_agg((event_id % 4000)::VARCHAR, ',' ORDER BY event_id)) ids FROM events GROUP BY 1")
def image_questions(t):
    return V.image_index(annotations(t)).select("image_id", F.size("question_ids").cast("long").alias("n"), F.md5(F.array_join("question_ids", ",")).alias("ids"))


@query("SELECT event_id % 4000 question_id, max(event_id) pos, arg_max(user_id, event_id) image_id FROM events GROUP BY 1")
def last_annotation(t):
    return V.question_index(annotations(t)).select("question_id", "pos", "image_id")


@query("SELECT list_position([7, 3, 11], user_id)::INT AS place, event_id AS pos, event_id % 4000 question_id FROM events WHERE user_id IN (7, 3, 11) AND event_id % 5 IN (1, 2) AND event_id % 3 = 0 UNION ALL SELECT -1, event_id, event_id % 4000 FROM events WHERE event_id % 3 = 1 AND event_id % 5 = 4")
def filtered_questions(t):
    a = annotations(t)
    return V.question_ids(a, [7, 3, 11], ["q1", "q2"], ["a0"]).unionByName(V.question_ids(a, [], ["q4"], ["a1"]).withColumn("place", F.lit(-1)))


_VOCAB = f"WITH q AS ({_PART}), v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS place FROM (SELECT DISTINCT p_brand AS word FROM part WHERE p_size % 2 = 0)), w AS (SELECT DISTINCT question_id, unnest(list_concat([choices[correct_choice_idx + 1]], direct_answers)) AS word FROM q), h AS (SELECT DISTINCT question_id, place FROM w JOIN v USING (word))"


def _vocab(t):
    words = t("part").where("p_size % 2 = 0").select(F.col("p_brand").alias("word")).distinct()
    return R.in_order(words, "word", "place").withColumn("place", F.col("place").cast("int"))


@query(_VOCAB + " SELECT question_id, array_to_string(list_transform(range(25), lambda i: list_contains(p, i)::INT), '') hot FROM (SELECT question_id, list(place) p FROM h GROUP BY 1)")
def answer_targets(t):
    rows = V.vocabulary_places(choices(t), _vocab(t))
    return rows.select("question_id", F.array_join(V.multi_hot(F.col("places"), 25), "").alias("hot"))


@query(_VOCAB + " SELECT round(100.0::DOUBLE * count(*) FILTER (choices[correct_choice_idx + 1] IN (SELECT word FROM v)) / count(*), 6) coverage FROM q")
def vocabulary_coverage(t):
    return V.coverage(choices(t).select(F.get("choices", F.col("correct_choice_idx")).alias("answer")), "answer", _vocab(t))


@query("WITH s AS (SELECT 'q' || event_id % 5 q, 'a' || event_id % 3 a, least(1.0::DOUBLE, (event_id % 7) / 3.0::DOUBLE) s FROM events) SELECT 'overall' AS level, 'overall' AS name, round(100 * avg(s), 2) accuracy FROM s UNION ALL SELECT 'question_type', q, round(100 * avg(s), 2) FROM s GROUP BY 2 UNION ALL SELECT 'answer_type', a, round(100 * avg(s), 2) FROM s GROUP BY 2")
def accuracy_by_type(t):
    return V.typed_accuracy(annotations(t).withColumn("score", F.least(F.lit(1.0), (F.col("pos") % 7) / 3)))


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '!' END AS a FROM orders), d AS (SELECT o_custkey, count(DISTINCT a) n FROM a GROUP BY 1),
b AS (SELECT o_custkey, o_orderkey, CASE WHEN n > 1 THEN replace(a, '!', ' ') ELSE a END AS x FROM a JOIN d USING (o_custkey)), g AS (SELECT o_custkey, lower(min(o_orderstatus)) guess FROM orders GROUP BY 1),
c AS (SELECT o_custkey, (x = guess)::INT h FROM b JOIN g USING (o_custkey)), s AS (SELECT o_custkey, least(1.0::DOUBLE, (sum(h) OVER (PARTITION BY o_custkey) - h)::DOUBLE / 3) s FROM c) SELECT o_custkey, round(avg(s), 6) score FROM s GROUP BY 1""")
def consensus_normalised(t):
    o = t("orders").withColumn("a", F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("!")))
    held = o.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("answer_id"), F.col("a").alias("answer"))).alias("answers"), F.min("o_orderstatus").alias("guess"))
    return held.select("o_custkey", F.round(V.consensus_score(F.col("guess"), F.col("answers")), 6).alias("score"))


@query(f"WITH q AS ({_PART}), p AS (SELECT p_partkey question_id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE 'Brand#' || (10 + p_partkey % 45) END prediction FROM part WHERE p_partkey % 11 <> 0) SELECT round(100 * avg(coalesce(CASE WHEN prediction IS NOT NULL THEN least(1.0::DOUBLE, len(list_filter(direct_answers, lambda x: lower(x) = lower(prediction))) / 3.0::DOUBLE) END, 0)), 6) accuracy FROM q LEFT JOIN p USING (question_id) WHERE NOT difficult_direct_answer")
def direct_answer_accuracy(t):
    k = F.col("p_partkey")
    guess = t("part").where(k % 11 != 0).select(k.alias("question_id"), F.when(k % 3 == 0, F.upper("p_brand")).otherwise(F.concat(F.lit("Brand#"), 10 + k % 45)).alias("prediction"))
    return V.direct_accuracy(choices(t), guess)


_CHOICE = f"WITH q AS ({_PART}), p AS (SELECT p_partkey question_id, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE 'none' END prediction FROM part WHERE p_partkey % 11 <> 0)"


def _picked(t):
    k = F.col("p_partkey")
    return t("part").where(k % 11 != 0).select(k.alias("question_id"), F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, F.col("p_type")).otherwise("none").alias("prediction"))


@query(_CHOICE + " SELECT round(100 * avg(coalesce((prediction = choices[correct_choice_idx + 1])::INT, 0)), 6) accuracy FROM q LEFT JOIN p USING (question_id)")
def multiple_choice_accuracy(t):
    return V.choice_accuracy(choices(t), _picked(t))


@query(_CHOICE + " SELECT question_id FROM q LEFT JOIN p USING (question_id) WHERE prediction IS NULL OR NOT list_contains(choices, prediction)")
def refused_predictions(t):
    return V.unknown_predictions(choices(t), _picked(t))


@query("SELECT 'all' AS kind, round(100 * avg((CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type ELSE '2' END = event_type)::INT), 6) accuracy FROM events UNION ALL SELECT 'some', NULL")
def exact_match(t):
    guess = F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("The "), F.col("event_type"), F.lit("."))).otherwise("two")
    rows = t("events").select(guess.alias("guess"), F.col("event_type").alias("truth"))
    missing = rows.withColumn("truth", F.when(F.col("truth") != "click", F.col("truth")))
    return V.exact_accuracy(rows).withColumn("kind", F.lit("all")).unionByName(V.exact_accuracy(missing).withColumn("kind", F.lit("some")))


@query("SELECT round(sum(doc_id % 6) FILTER (quality = 1)::DOUBLE / count(*), 6) average, count(*) FILTER (quality = 1 AND doc_id % 4 <> 3)::BIGINT AS read FROM labels")
def judge_scores(t):
    rows = t("labels").withColumn("reply", F.when(F.col("quality") != 1, "I think yes").when(F.col("doc_id") % 4 == 3, "[1]").otherwise(F.concat(F.lit("{'pred': 'yes', 'score': "), F.col("doc_id") % 6, F.lit("}"))))
    average = V.judge_average(rows.where("quality = 1").select((F.col("doc_id") % 6).alias("score")), rows)
    return average.join(rows.agg(F.count(V.judged(F.col("reply"))["score"]).alias("read")))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings), p AS (SELECT a.vec_id, a.e, b.e c1, c.e c2, d.e c3 FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id + 2 JOIN v d ON d.vec_id = a.vec_id + 3),
s AS (SELECT vec_id, list_dot_product(e, c1) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c1, c1))) s1, list_dot_product(e, c2) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c2, c2))) s2, list_dot_product(e, c3) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(c3, c3))) s3 FROM p)
SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'c2' WHEN s1 >= s2 AND s1 >= s3 THEN 'c1' WHEN s2 >= s3 THEN 'c2' ELSE 'c3' END choice, CASE WHEN s1 <= s2 THEN '0,1,2' ELSE '1,0,2' END ranks FROM s""")
def choice_by_vector(t):
    e = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    at = lambda k: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("v").alias(f"c{k}"))
    rows = e.join(at(1), "vec_id").join(at(2), "vec_id").join(at(3), "vec_id")
    names = F.array(*map(F.lit, ("c1", "c2", "c3")))
    guess = F.when(F.col("vec_id") % 5 == 0, "c2").otherwise("other")
    losses = F.array(*(N.cosine(F.col("v"), F.col(c)) for c in ("c1", "c2", "c3")))
    return rows.select("vec_id", V.nearest_choice(guess, names, F.col("v"), F.array("c1", "c2", "c3")).alias("choice"), F.array_join(V.ranked_by_loss(losses, F.lit(2)), ",").alias("ranks"))


@query("""WITH c AS (SELECT p_brand AS w, count(*) n, min(p_partkey) f FROM part WHERE p_size > 5 GROUP BY 1), q AS (SELECT s_suppkey, unnest(['Brand#' || (11 + s_suppkey % 50), 'Brand#' || (11 + s_nationkey)]) w, unnest([0, 1]) AS k FROM supplier),
b AS (SELECT s_suppkey, arg_max(w, (n, -k)) w FROM q JOIN c USING (w) GROUP BY 1) SELECT s_suppkey question_id, coalesce(b.w, (SELECT arg_max(w, (n, -f)) FROM c)) prediction FROM supplier LEFT JOIN b USING (s_suppkey)""")
def common_choices(t):
    counts = V.most_common(t("part").where("p_size > 5"), "p_brand", "p_partkey")
    brand = lambda c: F.concat(F.lit("Brand#"), 11 + c)
    asked = t("supplier").select(F.col("s_suppkey").alias("question_id"), F.array(brand(F.col("s_suppkey") % 50), brand(F.col("s_nationkey"))).alias("choices"))
    return V.common_choice(asked, counts, "p_brand")


def _captions(t):
    said = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), " ")
    return t("conversations").groupBy("conv_id").agg(said("assistant").alias("guess"), said("user").alias("reference"))


_TEXTS = r"""WITH t AS (SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ' ' ORDER BY turn), '') g, coalesce(string_agg(CASE WHEN role = 'user' THEN text END, ' ' ORDER BY turn), '') r FROM conversations GROUP BY 1),
w AS (SELECT conv_id, list_filter(regexp_split_to_array(g, '\s+'), lambda x: x <> '') g, list_filter(regexp_split_to_array(r, '\s+'), lambda x: x <> '') r FROM t),
n AS (SELECT unnest(range(1, 5)) n), gg AS (SELECT conv_id, n, w, count(*) c FROM (SELECT conv_id, n, unnest(list_transform(range(1, greatest(1, len(g)::BIGINT - n + 2)), lambda i: array_to_string(g[i:i + n - 1], ' '))) w FROM w, n) GROUP BY ALL),
rr AS (SELECT conv_id, n, w, count(*) c FROM (SELECT conv_id, n, unnest(list_transform(range(1, greatest(1, len(r)::BIGINT - n + 2)), lambda i: array_to_string(r[i:i + n - 1], ' '))) w FROM w, n) GROUP BY ALL)"""


@query(_TEXTS + """, h AS (SELECT gg.conv_id, gg.n, sum(least(gg.c, coalesce(rr.c, 0)))::DOUBLE h FROM gg LEFT JOIN rr USING (conv_id, n, w) GROUP BY ALL),
p AS (SELECT w.conv_id, n.n, coalesce(h, 0) h, greatest(1, len(g)::BIGINT - n.n + 1)::DOUBLE AS tot, len(g) lg, len(r) lr FROM w CROSS JOIN n LEFT JOIN h ON h.conv_id = w.conv_id AND h.n = n.n),
l AS (SELECT conv_id, n, ln(CASE WHEN h > 0 THEN h / tot ELSE 2.2250738585072014e-308::DOUBLE END) l, h, lg, lr FROM p),
s AS (SELECT conv_id, max(CASE WHEN n = 1 THEN h END) h1, CASE WHEN max(lg) = 0 THEN 0 WHEN max(lg) < max(lr) THEN exp(1 - max(lr)::DOUBLE / max(lg)) ELSE 1 END bp, sum(CASE WHEN n = 1 THEN l END) l1, sum(CASE WHEN n = 2 THEN l END) l2, sum(CASE WHEN n = 3 THEN l END) l3, sum(CASE WHEN n = 4 THEN l END) l4 FROM l GROUP BY 1)
SELECT round(avg(CASE WHEN h1 = 0 THEN 0 ELSE bp * exp(l1) END), 6) bleu1, round(avg(CASE WHEN h1 = 0 THEN 0 ELSE bp * exp(0.5 * l1 + 0.5 * l2) END), 6) bleu2, round(avg(CASE WHEN h1 = 0 THEN 0 ELSE bp * exp(0.33 * l1 + 0.33 * l2 + 0.33 * l3) END), 6) bleu3, round(avg(CASE WHEN h1 = 0 THEN 0 ELSE bp * exp(0.25 * l1 + 0.25 * l2 + 0.25 * l3 + 0.25 * l4) END), 6) bleu4 FROM s""")
def bleu_scores(t):
    return V.corpus_bleu(_captions(t), "conv_id")


@query(_TEXTS + """, d AS (SELECT n, w, count(*) df FROM rr GROUP BY ALL), z AS (SELECT ln(count(*)) z FROM w), gv AS (SELECT gg.*, gg.c * (z - ln(greatest(1, coalesce(df, 0)))) v FROM gg CROSS JOIN z LEFT JOIN d USING (n, w)), rv AS (SELECT rr.*, rr.c * (z - ln(greatest(1, coalesce(df, 0)))) v FROM rr CROSS JOIN z LEFT JOIN d USING (n, w)),
gn AS (SELECT conv_id, n, sqrt(sum(v * v)) nv FROM gv GROUP BY ALL), rn AS (SELECT conv_id, n, sqrt(sum(v * v)) nv FROM rv GROUP BY ALL), k AS (SELECT gv.conv_id, gv.n, sum(least(gv.v, rv.v) * rv.v) dot FROM gv JOIN rv USING (conv_id, n, w) GROUP BY ALL),
s AS (SELECT k.conv_id, sum(coalesce(dot / nullif(gn.nv * rn.nv, 0), 0) * exp(-power(greatest(len(g)::BIGINT - 1, 0) - greatest(len(r)::BIGINT - 1, 0), 2) / 72.0)) s FROM k JOIN gn USING (conv_id, n) JOIN rn USING (conv_id, n) JOIN w USING (conv_id) GROUP BY 1)
SELECT w.conv_id, round(coalesce(10 * s / 4, 0), 6) cider FROM w LEFT JOIN s USING (conv_id)""")
def cider_scores(t):
    pairs = _captions(t)
    return V.cider(pairs.select("conv_id", F.col("guess").alias("text")), pairs.select("conv_id", F.col("reference").alias("text")), "conv_id")


@query("""WITH o AS (SELECT p_partkey, row_number() OVER (ORDER BY md5(p_partkey || '|0')) - 1 AS seat FROM part), n AS (SELECT count(*) n FROM part), q AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END context, (('0x' || md5(s_suppkey || '|0')[1:8])::BIGINT) % n f, n FROM supplier, n)
SELECT s_suppkey question_id, context, string_agg(p_partkey::VARCHAR, ',' ORDER BY k) examples FROM q, range(0, 10) r(k), o WHERE o.seat = (f + k) % n GROUP BY ALL""")
def few_shots(t):
    asked = t("supplier").select(F.col("s_suppkey").alias("question_id"))
    known = t("supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("question_id"), F.col("s_name").alias("context"))
    rows = V.prior_contexts(asked, known, t("part").select(F.col("p_partkey").alias("example_id")))
    return rows.select("question_id", "context", F.array_join("examples", ",").alias("examples"))


@query("SELECT p_partkey, 'couldn''t 2 cats ' || CASE WHEN p_partkey % 2 = 0 THEN 'they''ve' ELSE 'somebodyd' END words FROM part")
def contractions(t):
    text = F.concat(F.lit("The Couldnt TWO an cats "), F.when(F.col("p_partkey") % 2 == 0, "theyve").otherwise("somebody'd"))
    return t("part").select("p_partkey", T.digits_articles(text).alias("words"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '' ELSE upper(p_name) END response, CASE WHEN p_size % 7 = 0 THEN 'no size ' || p_size END AS error FROM part")
def model_rows(t):
    def shout(prompt: str) -> str:
        size, name = prompt.split("|")
        if int(size) % 7 == 0:
            raise ValueError(f"no size {size}")
        return name.upper()

    return P.call_rows(t("part").select("p_partkey", F.concat_ws("|", "p_size", "p_name").alias("prompt")), "prompt", shout).select("p_partkey", "response", "error")


@query("WITH b AS (SELECT o_custkey, o_orderkey, o_orderstatus, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 8 b FROM orders), f AS (SELECT o_custkey, b, bool_or(o_orderstatus = 'P') bad FROM b GROUP BY ALL) SELECT o_orderkey, CASE WHEN bad THEN NULL ELSE lower(o_orderstatus) END response, CASE WHEN bad THEN 'partial' END AS error FROM b JOIN f USING (o_custkey, b)")
def model_batches(t):
    def lower(prompts: list[str]) -> list[str]:
        if "P" in prompts:
            raise ValueError("partial")
        return [p.lower() for p in prompts]

    rows = P.in_batches(t("orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")
    return P.call_batches(rows, ["o_custkey"], "o_orderkey", "o_orderstatus", lower).select("o_orderkey", "response", "error")


@query("SELECT p_partkey, length(p_name)::DOUBLE size, CASE WHEN p_size % 2 = 0 THEN 'yes' END pred, CASE WHEN p_retailprice > 1000 THEN p_brand || chr(10) || chr(10) || 'Question: ' || p_type ELSE p_type END prompt, 'Q: ' || p_name || chr(10) || 'A:' || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' ' || p_brand END shot FROM part")
def model_inputs(t):
    rows = P.embedded(t("part").select("p_partkey", "p_name", "p_size", "p_brand", "p_type", "p_retailprice"), "p_name", lambda texts: [[float(len(x))] for x in texts])
    verdicts = t("part").where("p_size % 2 = 0").select("p_partkey", F.lit("yes").alias("pred"), F.lit(5.0).alias("score"))
    asked = P.answer_route(F.col("p_retailprice"), F.col("p_brand"), F.col("p_type"), long=1000.0)
    shot = P.shot_text(F.col("p_name"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")))
    return P.judged_by(rows, verdicts, ["p_partkey"]).select("p_partkey", F.get("embedding", 0).cast("double").alias("size"), "pred", asked["prompt"].alias("prompt"), shot.alias("shot"))


@query("SELECT split, count(*) n FROM (SELECT CASE WHEN s_nationkey % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM supplier UNION ALL SELECT 'train' FROM customer WHERE c_nationkey % 5 <> 0) GROUP BY 1")
def united_splits(t):
    s = t("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), "s_acctbal")
    c = t("customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), "c_mktsegment")
    sets = P.by_split({"s": {"train": s.where("k % 5 <> 0"), "val": s.where("k % 5 = 0")}, "c": {"train": c.where("k % 5 <> 0")}})
    return P.split_sizes(sets["train"].withColumn("split", F.lit("train")).unionByName(sets["val"].withColumn("split", F.lit("val")), allowMissingColumns=True))
