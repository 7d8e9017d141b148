"""Queries of the evaluation, over results that stand on the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotloom.operators import evaluation as E
from plotloom.operators import metrics as M
from plotloom.plans.catalogue import _LETTER, _METRICS
from plotloom.operators.tasks import task
from plotloom.plans.registry import query

_KINDS = ("single target recall", "boolean", "temporal: chronological ordering", "temporal: latest event retrieval", "temporal: single cue retrieval", "open")


def results(t) -> DataFrame:
    """A result tree: each event is an answered question of a model, run and configuration."""
    e, letter = F.col("event_id"), F.char((F.floor(F.col("value") * 7) % 4 + 65).cast("int"))
    shape = F.col("user_id") % 7
    response = F.when(shape == 0, F.concat(F.lit("The answer is "), letter)).when(shape == 1, letter).when(shape == 2, "").when(shape == 3, F.concat(F.lit("I choose "), letter, F.lit(".")))
    response = response.when(shape == 4, F.concat(F.lit("("), letter, F.lit(") yes"))).when(shape == 5, "None of these").otherwise(F.concat(F.char((F.col("event_id") % 4 + 65).cast("int")), F.lit(". x")))
    kinds = F.array(*map(F.lit, _KINDS))
    return t("events").select(
        e.alias("question_id"), F.concat(F.lit("m_"), "event_type").alias("model"), F.concat(F.lit("run_"), e % 3 + 1).alias("run"),
        F.when(F.col("user_id") % 2 == 0, "with_context").otherwise("without_context").alias("context"),
        F.when(F.col("user_id") % 2 == 0, "vanilla").otherwise(F.concat(F.lit("nn_"), F.col("user_id") % 3)).alias("nn"),
        F.when(e % 17 == 0, "Who called Ross?").when(e % 29 == 0, "An unknown one?").otherwise("Where is it?").alias("question"),
        F.array(F.concat(F.lit("opt"), e % 4), F.concat(F.lit("opt"), F.col("user_id") % 4), F.concat(F.lit(" OPT"), e % 4), F.when(e % 31 == 0, "All").otherwise("x")).alias("options"),
        (e % 4).cast("int").alias("answer_index"), F.when(e % 23 == 0, "").otherwise(F.char((e % 4 + 65).cast("int"))).alias("truth"), response.alias("response"),
        F.when(e % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.date_format("ts", "MMdd"), F.lit("x"))).alias("episode_span"),
        F.when(e % 6 < 5, F.get(kinds, (e % 6).cast("int"))).when(e % 5 == 0, F.lit(None)).otherwise("open").alias("question_type"),
    )


_RESULTS = """
WITH a AS (SELECT *, chr(((floor(value * 7)::BIGINT % 4) + 65)::INT) l, chr((event_id % 4 + 65)::INT) g FROM events),
r AS (SELECT event_id, 'm_' || event_type model, 'run_' || (event_id % 3 + 1) run, CASE WHEN user_id % 2 = 0 THEN 'with_context' ELSE 'without_context' END context, CASE WHEN user_id % 2 = 0 THEN 'vanilla' ELSE 'nn_' || (user_id % 3) END nn,
['opt' || (event_id % 4), 'opt' || (user_id % 4), ' OPT' || (event_id % 4), CASE WHEN event_id % 31 = 0 THEN 'All' ELSE 'x' END] options,
CASE WHEN event_id % 23 = 0 THEN '' ELSE g END truth,
CASE user_id % 7 WHEN 0 THEN 'The answer is ' || l WHEN 1 THEN l WHEN 2 THEN '' WHEN 3 THEN 'I choose ' || l || '.' WHEN 4 THEN '(' || l || ') yes' WHEN 5 THEN 'None of these' ELSE g || '. x' END s,
CASE WHEN event_id % 13 = 0 THEN NULL ELSE strftime(ts, '%m%d') END episode,
CASE event_id % 6 WHEN 0 THEN 'Single Target Recall' WHEN 1 THEN 'Boolean' WHEN 2 THEN 'Temporal: Chronological Ordering' WHEN 3 THEN 'Temporal: Latest Event Retrieval' WHEN 4 THEN 'Temporal: Location Sequence Recognition' ELSE CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'open' END END kind
FROM a WHERE event_id % 17 <> 0 AND event_id % 29 <> 0 AND event_id % 31 <> 0),
q AS (SELECT *, """ + _LETTER + """ letter FROM (SELECT *, upper(s) u FROM r)),
k AS (SELECT *, letter IS NOT NULL AND truth <> '' AND (letter = truth OR lower(trim(options[ascii(letter) - 64])) = lower(trim(options[ascii(truth) - 64]))) AS correct, CASE WHEN length(truth) = 1 THEN ascii(truth) - 65 ELSE -1 END ti, coalesce(ascii(letter) - 65, -1) pi FROM q),
c AS (SELECT model, run, context, nn, 'overall' cat_type, 'overall' cat_name, correct, ti, pi FROM k UNION ALL SELECT model, run, context, nn, 'question_type', kind, correct, ti, pi FROM k UNION ALL SELECT model, run, context, nn, 'episode', episode, correct, ti, pi FROM k WHERE episode IS NOT NULL),
n AS (SELECT model, run, context, nn, cat_type, cat_name, count(*) total, count(*) FILTER (correct) AS correct FROM c GROUP BY ALL),
base AS (SELECT model, run, context, nn, cat_type, cat_name, ti::VARCHAR t, pi::VARCHAR p FROM c WHERE ti >= 0)
"""
_KEYS = "model, run, context, nn, cat_type, cat_name,"
_CONFIG = _RESULTS + _METRICS.format(k=_KEYS, g="GROUP BY " + _KEYS[:-1]).replace(", 6)", ", 12)").replace("\nSELECT " + _KEYS, ",\nm AS (SELECT " + _KEYS) + """),
w AS (SELECT n.model, n.run, n.context, n.nn, n.cat_type, n.cat_name, CASE WHEN m.model IS NULL THEN 0 ELSE n.total END total, CASE WHEN m.model IS NULL THEN 0 ELSE n.correct END AS correct, CASE WHEN m.model IS NULL THEN 0.0::DOUBLE ELSE round(n.correct::DOUBLE / n.total, 12) END accuracy,
CASE WHEN m.model IS NULL THEN 0.0 ELSE precision_macro END precision_macro, CASE WHEN m.model IS NULL THEN 0.0 ELSE precision_weighted END precision_weighted, CASE WHEN m.model IS NULL THEN 0.0 ELSE recall_macro END recall_macro, CASE WHEN m.model IS NULL THEN 0.0 ELSE recall_weighted END recall_weighted,
CASE WHEN m.model IS NULL THEN 0.0 ELSE f1_macro END f1_macro, CASE WHEN m.model IS NULL THEN 0.0 ELSE f1_weighted END f1_weighted, CASE WHEN m.model IS NULL THEN 0.0 ELSE kappa END kappa
FROM n LEFT JOIN m ON n.model = m.model AND n.run = m.run AND n.context = m.context AND n.nn = m.nn AND n.cat_type = m.cat_type AND n.cat_name = m.cat_name)
"""
_AVERAGES = _CONFIG + ", v AS (SELECT model, context, nn, cat_type, cat_name, trunc(avg(total))::BIGINT total, trunc(avg(correct))::BIGINT AS correct, " + ", ".join(f"round(avg({c}), 6) {c}, round(stddev_pop({c}), 6) {c}_std" for c in E.SCORES) + " FROM w GROUP BY ALL)\n"


@query(_CONFIG + "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in E.SCORES) + ") FROM w")
def metrics_by_config(t):
    return E.config_metrics(results(t), 6)


@query(_AVERAGES + "SELECT * FROM v")
def evaluation_report(t):
    return E.over_runs(E.config_metrics(results(t)))


@query(_AVERAGES + "SELECT cat_type, cat_name, " + ", ".join(f"max(CASE WHEN model = 'm_{m}' AND nn = 'vanilla' THEN {c} END) \"m_{m}/with_context/vanilla_{c}\"" for m in ("click", "view") for c in ("accuracy", "f1_macro", "kappa")) + " FROM v GROUP BY ALL")
def metrics_comparison(t):
    return E.pivoted(E.over_runs(E.config_metrics(results(t))), ["m_click/with_context/vanilla", "m_view/with_context/vanilla"])


# The text reports round as printf does, from the exact binary value; tests hold them against a brute-force version.
@query(None)
def evaluation_summaries(t):
    return E.summary_lines(E.config_metrics(results(t)))


@query(None)
def evaluation_final_summary(t):
    return E.final_lines(E.over_runs(E.config_metrics(results(t))))


@query("SELECT lang, source, " + "x.* EXCLUDE (lang, source) FROM (WITH base AS (SELECT d.lang, d.source, quality::VARCHAR t, toxic::VARCHAR p FROM labels JOIN documents d USING (doc_id) UNION ALL SELECT NULL, d.source, quality::VARCHAR, toxic::VARCHAR FROM labels JOIN documents d USING (doc_id) UNION ALL SELECT d.lang, NULL, quality::VARCHAR, toxic::VARCHAR FROM labels JOIN documents d USING (doc_id) UNION ALL SELECT NULL, NULL, quality::VARCHAR, toxic::VARCHAR FROM labels)" + _METRICS.format(k="lang, source,", g="GROUP BY lang, source") + ") x")
def metrics_levels(t):
    rows = t("labels").join(t("documents").select("doc_id", "lang", "source"), "doc_id").select("lang", "source", F.col("quality").cast("string").alias("t"), F.col("toxic").cast("string").alias("p"))
    levels = F.array(*(F.struct(lang.alias("lang"), source.alias("source")) for lang, source in ((F.col("lang"), F.col("source")), (F.lit(None), F.col("source")), (F.col("lang"), F.lit(None)), (F.lit(None), F.lit(None)))))
    cells = rows.groupBy("lang", "source", "t", "p").agg(F.count("*").alias("n"))  # before each cell counts at four levels
    spread = cells.select("t", "p", "n", F.explode(levels).alias("k")).groupBy("k.lang", "k.source", "t", "p").agg(F.sum("n").alias("n"))
    return M.confusion_metrics(spread, ["lang", "source"])


@query("WITH p AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'view' END prediction FROM events WHERE event_id % 5 <> 0), e AS (SELECT user_id % 4 AS grp, event_type, prediction FROM events LEFT JOIN p USING (event_id)) SELECT grp, count(*) n, count(*) FILTER (prediction = event_type) hits, round(count(*) FILTER (prediction = event_type) / count(*), 6) accuracy FROM e GROUP BY 1")
def task_scores(t):
    """A task by its name: predictions of four fifths of the events, a third of them right."""
    samples = t("events").select(F.col("event_id").alias("question_id"), F.col("event_type").alias("answer"), (F.col("user_id") % 4).alias("grp"))
    guess = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, "view")
    predictions = t("events").where("event_id % 5 <> 0").select(F.col("event_id").alias("question_id"), guess.alias("prediction"))
    return task("exact_match").evaluate(samples, predictions, ["grp"])
