"""Aggregate states that can be stored and merged, so that a new run's rows are read once and old ones never again."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotloom.operators.metrics import confusion_metrics


def confusion_state(rows: DataFrame, truth: str, guess: str, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, t, p, n): how often each guess was made for each truth."""
    return rows.groupBy(*keys, F.col(truth).cast("string").alias("t"), F.col(guess).cast("string").alias("p")).agg(F.count("*").alias("n"))


def merged_confusion(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One state of any number of states."""
    return states.groupBy(*keys, "t", "p").agg(F.sum("n").alias("n"))


def confusion_scores(states: DataFrame, keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Accuracy, precision, recall, F1 and kappa of merged states; see ``metrics.class_metrics``."""
    return confusion_metrics(merged_confusion(states, keys), keys, digits)


def moment_state(rows: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, value, n, mean, m2, low, high) of each of ``values``: m2 is the sum of squared distances to the mean. Nulls don't count; a value with none but nulls has n 0."""
    one = lambda v: F.struct(F.lit(v).alias("value"), F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(F.col(v).cast("double")).alias("low"), F.max(F.col(v).cast("double")).alias("high"))
    return rows.groupBy(*keys).agg(F.array(*map(one, values)).alias("s")).select(*keys, F.explode("s").alias("s")).select(*keys, "s.*")


def merged_moments(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One state of any number of states. Means meet around the common mean, not as sums of squares, which would cancel each other for large values."""
    by = Window.partitionBy(*keys, "value")
    whole = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(by), F.sum("n").over(by))
    rows = states.withColumn("_mean", whole).withColumn("_m2", F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2)
    return rows.groupBy(*keys, "value").agg(F.sum("n").alias("n"), F.max("_mean").alias("mean"), F.sum("_m2").alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"))


def moment_scores(states: DataFrame, keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """(*keys, value, n, mean, deviation, low, high) of merged states; the deviation is that of the population."""
    rows = merged_moments(states, keys)
    return rows.select(*keys, "value", "n", F.round("mean", digits).alias("mean"), F.round(F.sqrt(F.try_divide("m2", "n")), digits).alias("deviation"), "low", "high")


def sum_state(rows: DataFrame, sums: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, *sums): the partial half of a sum over processes; merged_sums is the other."""
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def merged_sums(states: Sequence[DataFrame] | DataFrame, sums: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The sums of any number of states."""
    rows = states if isinstance(states, DataFrame) else reduce(DataFrame.unionByName, states)
    return sum_state(rows, sums, keys)
