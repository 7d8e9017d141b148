"""Scores of answers: one pass over a confusion table, however many groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_metrics(rows: DataFrame, truth: str, guess: str, keys: Sequence[str] = ()) -> DataFrame:
    """total, correct, accuracy, macro and weighted precision, recall and F1, and kappa for each combination of ``keys``.

    Classes are all values of truth and guess. 0 stands for 0 / 0; kappa is null when chance agreement is 1. Only the
    confusion table (classes squared) is shuffled after its partial counts.
    """
    cells = rows.groupBy(*keys, F.col(truth).cast("string").alias("t"), F.col(guess).cast("string").alias("p")).agg(F.count("*").alias("n"))
    return confusion_metrics(cells, keys)


def confusion_metrics(cells: DataFrame, keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """The same from a confusion table (*keys, t, p, n), rounded to ``digits``."""
    keys = list(keys)
    side = F.explode(F.array(F.struct(F.col("t").alias("c"), F.lit(1).alias("is_t"), F.lit(0).alias("is_p")), F.struct(F.col("p").alias("c"), F.lit(0).alias("is_t"), F.lit(1).alias("is_p"))))
    by = cells.select(*keys, "n", "t", "p", side.alias("s")).groupBy(*keys, F.col("s.c").alias("c")).agg(
        F.sum(F.col("n") * F.col("s.is_t")).alias("support"), F.sum(F.col("n") * F.col("s.is_p")).alias("named"),
        F.sum(F.when((F.col("t") == F.col("p")) & (F.col("s.is_t") == 1), F.col("n")).otherwise(0)).alias("hit"),
    )
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    by = by.withColumn("pr", zero(F.col("hit"), F.col("named"))).withColumn("rc", zero(F.col("hit"), F.col("support")))
    by = by.withColumn("f1", zero(2 * F.col("pr") * F.col("rc"), F.col("pr") + F.col("rc")))
    total = F.sum("support")
    weigh = lambda c: zero(F.sum(F.col(c) * F.col("support")), total)
    agreed, chance = F.sum("hit") / total, F.sum(F.col("support") * F.col("named")) / (total * total)
    round_ = lambda c: F.round(c, digits)
    return by.groupBy(*keys).agg(
        total.cast("long").alias("total"), F.sum("hit").cast("long").alias("correct"), round_(agreed).alias("accuracy"),
        round_(F.avg("pr")).alias("precision_macro"), round_(weigh("pr")).alias("precision_weighted"),
        round_(F.avg("rc")).alias("recall_macro"), round_(weigh("rc")).alias("recall_weighted"),
        round_(F.avg("f1")).alias("f1_macro"), round_(weigh("f1")).alias("f1_weighted"),
        round_(F.try_divide(agreed - chance, 1 - chance)).alias("kappa"),
    )


def mean_and_deviation(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*(f for v in values for f in (F.round(F.avg(v), 6).alias(v), F.round(F.stddev_pop(v), 6).alias(f"{v}_std"))))


def consensus(answers: DataFrame, question: str, answer: str, guess: str) -> DataFrame:
    """The share of people who back the guess: for each answer, min(1, others equal to the guess / 3), averaged by question."""
    whole = Window.partitionBy(question)
    equal = (F.col(answer) == F.col(guess)).cast("int")
    others = F.sum(equal).over(whole) - equal
    return answers.withColumn("_s", F.least(F.lit(1.0), others / 3)).groupBy(question).agg(F.round(F.avg("_s"), 6).alias("score"))


def ngram_precision(pairs: DataFrame, key: str, guess: Column, reference: Column, n: int) -> DataFrame:
    """(key, hits, total): n-grams of the guess, clipped by how often the reference has them."""
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(c, i, n), " "))
    words = pairs.select(key, F.split(guess, " ").alias("g"), F.split(reference, " ").alias("r"))
    words = words.where((F.size("g") >= n) & (F.size("r") >= n))
    one = words.select(key, F.explode(grams(F.col("g"))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("a"))
    two = words.select(key, F.explode(grams(F.col("r"))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("b"))
    return one.join(two, [key, "w"], "left").groupBy(key).agg(F.sum(F.least("a", F.coalesce("b", F.lit(0)))).alias("hits"), F.sum("a").alias("total"))
