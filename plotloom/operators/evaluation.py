"""The evaluation of a result tree: kept questions, scores of every run and category, means over runs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotloom.functions import text as T
from plotloom.operators.metrics import confusion_metrics

# The names under which question types are reported.
TYPE_NAMES = {
    "single target recall": "Single Target Recall",
    "boolean": "Boolean",
    "temporal: chronological ordering": "Temporal: Chronological Ordering",
    "temporal: latest event retrieval": "Temporal: Latest Event Retrieval",
    "temporal: single cue retrieval": "Temporal: Location Sequence Recognition",
}
SCORES = ("accuracy", "precision_macro", "precision_weighted", "recall_macro", "recall_weighted", "f1_macro", "f1_weighted", "kappa")
CONFIG = ("model", "context", "nn")
CATEGORY = ("cat_type", "cat_name")


def type_name(kind: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in TYPE_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, kind), kind, F.lit("unknown"))


def shown_config(nn: Column) -> Column:
    return F.when(nn == "vanilla", "Vanilla").otherwise(nn)


def scored(results: DataFrame) -> DataFrame:
    """Kept rows of (question, options, answer_index, response, truth, ...) with ``correct``, ``t`` and ``p``: the letters' numbers, -1 for none."""
    truth = F.coalesce("truth", F.lit(""))
    letter = T.answer_letter(F.col("response"))
    kept = results.where(T.question_kept(F.coalesce("question", F.lit("")), F.coalesce("options", F.array().cast("array<string>")), F.coalesce("answer_index", F.lit(-1))))
    return kept.withColumn("correct", T.is_correct(letter, truth, F.col("options"))).withColumn("t", T.letter_index(truth)).withColumn("p", F.coalesce(T.letter_index(letter), F.lit(-1)))


def in_categories(rows: DataFrame) -> DataFrame:
    """Each row once overall, once for its question type, and once for the first episode of its span, if it has one."""
    span = F.coalesce("episode_span", F.array().cast("array<string>"))
    pair = lambda kind, name: F.struct(F.lit(kind).alias("cat_type"), name.cast("string").alias("cat_name"))
    own = F.array(pair("overall", F.lit("overall")), pair("question_type", type_name(F.col("question_type"))))
    every = F.when(F.size(span) > 0, F.concat(own, F.array(pair("episode", F.get(span, 0))))).otherwise(own)
    return rows.withColumn("_c", F.explode(every)).select("*", "_c.cat_type", "_c.cat_name").drop("_c")


def config_metrics(results: DataFrame, digits: int = 12) -> DataFrame:
    """Scores for each (model, run, context, nn, cat_type, cat_name): counts over all kept questions, classes over those with a true letter.

    Where no question has a true letter everything is 0. One shuffle of partial counts: five columns of keys, two of classes.
    """
    keys = ["model", "run", "context", "nn", *CATEGORY]
    cells = in_categories(scored(results)).groupBy(*keys, "t", "p").agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))
    counts = cells.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("right").alias("correct"))
    by_class = confusion_metrics(cells.where("t >= 0"), keys, digits).drop("total", "correct", "accuracy")
    usable = F.col("f1_macro").isNotNull()
    zero = lambda c: F.when(usable, F.col(c)).otherwise(F.lit(0.0)).alias(c)
    return counts.join(by_class, keys, "left").select(
        *keys, F.when(usable, F.col("total")).otherwise(0).cast("long").alias("total"), F.when(usable, F.col("correct")).otherwise(0).cast("long").alias("correct"),
        F.when(usable, F.round(F.col("correct") / F.col("total"), digits)).otherwise(F.lit(0.0)).alias("accuracy"), *(zero(c) for c in SCORES[1:]),
    )


def over_runs(metrics: DataFrame) -> DataFrame:
    """Mean and population deviation of each score over the runs of (model, context, nn, cat_type, cat_name); mean counts lose their fractions."""
    whole = [F.avg(c).cast("long").alias(c) for c in ("total", "correct")]
    return metrics.groupBy(*CONFIG, *CATEGORY).agg(*whole, *(f for c in SCORES for f in (F.round(F.avg(c), 6).alias(c), F.round(F.stddev_pop(c), 6).alias(f"{c}_std"))))


def _fixed(c: Column) -> Column:
    return F.replace(F.format_number(c, 4), F.lit(","), F.lit(""))


def _left(c: Column, n: int) -> Column:
    return F.rpad(c, F.greatest(F.length(c), F.lit(n)), F.lit(" "))


def _right(c: Column, n: int) -> Column:
    return F.lpad(c, F.greatest(F.length(c), F.lit(n)), F.lit(" "))


def comparison(averages: DataFrame) -> DataFrame:
    """(cat_type, cat_name, model, context, config, acc, f1, kappa): each score as ``mean +/- deviation``, with a line of the final report."""
    text = lambda c: F.concat(_fixed(F.coalesce(c, F.lit(0.0))), F.lit(" +/- "), _fixed(F.coalesce(f"{c}_std", F.lit(0.0))))
    shown = averages.select(*CATEGORY, "model", "context", shown_config(F.col("nn")).alias("config"), text("accuracy").alias("acc"), text("f1_macro").alias("f1"), text("kappa").alias("kappa"))
    line = F.concat_ws(" ", _left(F.col("model"), 25), _left(F.col("context"), 20), _left(F.col("config"), 15), *(_right(F.col(c), 18) for c in ("acc", "f1", "kappa")))
    return shown.withColumn("line", line)


def pivoted(averages: DataFrame, configs: list[str]) -> DataFrame:
    """(cat_type, cat_name, <config>_accuracy, <config>_f1_macro, <config>_kappa): configurations side by side, null where one lacks the category."""
    name = F.concat_ws("/", *CONFIG)
    return averages.withColumn("_config", name).groupBy(*CATEGORY).pivot("_config", configs).agg(*(F.first(c).alias(c) for c in ("accuracy", "f1_macro", "kappa")))


def summary_lines(metrics: DataFrame) -> DataFrame:
    """(file, line_no, line): the text report of each run and configuration; types come before episodes, categories by name."""
    num = lambda c: _left(F.col(c).cast("string"), 8)
    score = lambda c: _left(_fixed(F.coalesce(F.col(c), F.lit(0.0))), 8)
    body = F.concat_ws(" ", _left(F.col("cat_name"), 40), num("total"), num("correct"), *(score(c) for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro", "kappa")))
    keys = ["model", "run", "context", "nn"]
    rows = metrics.where("cat_type <> 'overall'").select(*keys, "cat_type", F.struct("cat_name", body.alias("line")).alias("r"))
    held = rows.groupBy(*keys).agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("cat_type") == k, F.col("r")))), lambda x: x["line"]).alias(k) for k in ("question_type", "episode")))
    whole = metrics.where("cat_type = 'overall'").join(held, keys, "left")
    lit, wide = F.lit, lambda c: F.array(F.lit(c * 100))
    head = F.concat_ws(" ", _left(lit("Category"), 40), *(_left(lit(x), 8) for x in ("Total", "Correct", "Acc", "P(M)", "R(M)", "F1(M)", "Kappa")))
    value = lambda label, c: F.concat(lit(label), _fixed(F.coalesce(F.col(c), lit(0.0))))
    block = lambda title, c: F.concat(wide("="), F.array(lit(f"PERFORMANCE BY {title}")), wide("="), F.array(head), wide("-"), F.coalesce(F.col(c), F.array().cast("array<string>")), F.array(lit("")))
    title = F.concat_ws(" - ", "model", "run", "context", shown_config(F.col("nn")))
    lines = F.concat(
        wide("="), F.array(title), wide("="),
        F.array(
            F.concat(lit("Total Questions: "), "total"), F.concat(lit("Correct Answers: "), "correct"), value("Accuracy: ", "accuracy"), lit(""), lit("Detailed Metrics:"),
            value("  Precision (Macro):    ", "precision_macro"), value("  Precision (Weighted): ", "precision_weighted"), value("  Recall (Macro):       ", "recall_macro"), value("  Recall (Weighted):    ", "recall_weighted"),
            value("  F1 Score (Macro):     ", "f1_macro"), value("  F1 Score (Weighted):  ", "f1_weighted"), value("  Cohen's Kappa:        ", "kappa"), lit(""),
        ),
        block("QUESTION TYPE", "question_type"), block("EPISODE", "episode"),
    )
    file = F.concat(F.concat_ws("_", *keys), lit(".txt"))
    return whole.select(file.alias("file"), F.posexplode(lines).alias("line_no", "line"))


def final_lines(averages: DataFrame) -> DataFrame:
    """(part, cat_name, line): the lines of the final report; part 0 is overall, 1 question types, 2 episodes, then configurations by key."""
    part = F.when(F.col("cat_type") == "overall", 0).when(F.col("cat_type") == "question_type", 1).otherwise(2)
    label = F.when(F.col("cat_type") == "question_type", F.concat(F.lit("type_"), "cat_name")).otherwise(F.col("cat_name"))
    rows = comparison(averages)
    return rows.select(part.alias("part"), label.alias("cat_name"), F.row_number().over(Window.partitionBy("cat_type", "cat_name").orderBy("model", "context", "config")).alias("place"), "line")
