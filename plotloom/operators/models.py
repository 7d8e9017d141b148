"""Calls of models that a caller brings: a row, a batch or a vector at a time, with their failures as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *fields])


def call_rows(rows: DataFrame, prompt: str, model: Callable[[str], str]) -> DataFrame:
    """Adds response, seconds and error: a failed call gives '' and its message, and the others go on."""
    schema = _with(rows.schema, T.StructField("response", T.StringType()), T.StructField("seconds", T.DoubleType()), T.StructField("error", T.StringType()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p in f[prompt]:
                began, answer, error = time.perf_counter(), "", None
                try:
                    answer = model(p)
                except Exception as e:  # a model may fail in any way
                    error = str(e)
                out.append((answer, time.perf_counter() - began, error))
            yield f.assign(response=[a for a, _, _ in out], seconds=[s for _, s, _ in out], error=[e for _, _, e in out])

    return rows.mapInPandas(run, schema)


def in_batches(rows: DataFrame, keys: Sequence[str], order: str, size: int = 8) -> DataFrame:
    """Adds ``batch``: rows of the same keys, ``size`` after ``size`` in order."""
    from pyspark.sql import Window

    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / size))


def call_batches(rows: DataFrame, keys: Sequence[str], order: str, prompt: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Adds response and error to rows with ``batch``: a batch is one call, whose failure stands on each of its rows.

    Rows come numbered and sorted by batch, so a task takes its batches from Arrow frames one after another; one that a frame cuts waits for the next.
    """
    from pyspark.sql import Window

    schema = _with(rows.schema, T.StructField("response", T.StringType()), T.StructField("error", T.StringType()))
    names = [*keys, "batch"]

    def call(f: pd.DataFrame) -> pd.DataFrame:
        prompts, answers, errors = f[prompt].tolist(), [], []
        edges = [*np.flatnonzero(f["_turn"].to_numpy() == 1).tolist(), len(f)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            try:
                found, error = list(model(prompts[low:high])), None
                if len(found) != high - low:
                    raise ValueError(f"{len(found)} answers to {high - low} prompts")
            except Exception as e:  # a model may fail in any way
                found, error = [None] * (high - low), str(e)
            answers += found
            errors += [error] * (high - low)
        return f.drop(columns="_turn").assign(response=pd.Series(answers, f.index, object), error=pd.Series(errors, f.index, object))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last batch, as far as it has come
        for f in frames:
            begins = np.flatnonzero(f["_turn"].to_numpy() == 1)
            if not len(begins):
                held.append(f)
                continue
            done = pd.concat([*held, f.iloc[: begins[-1]]], ignore_index=True)
            held = [f.iloc[begins[-1] :]]
            if len(done):
                yield call(done)
        if held:
            yield call(pd.concat(held, ignore_index=True))

    numbered = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*names).orderBy(order)))
    return numbered.sortWithinPartitions(*names, "_turn").mapInPandas(run, schema)


def embedded(rows: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Adds embedding; equal texts of an Arrow batch are sent once."""
    schema = _with(rows.schema, T.StructField("embedding", T.ArrayType(T.FloatType())))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = list(dict.fromkeys(f[text].fillna("")))
            known = dict(zip(texts, model(texts), strict=True)) if texts else {}
            yield f.assign(embedding=[known[x] for x in f[text].fillna("")])

    return rows.mapInPandas(run, schema)


def judged_by(rows: DataFrame, verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds pred and score of a table of verdicts; null where there is none."""
    return rows.join(verdicts.select(*keys, "pred", "score").dropDuplicates(list(keys)), list(keys), "left")


def answer_route(seconds: Column, context: Column, question: Column, long: float = 180.0, words: int = 10_000) -> Column:
    """struct<long, prompt>: videos over ``long`` seconds are asked with what was retrieved, cut to its first words; short ones with the question alone."""
    cut = F.array_join(F.slice(F.split(F.coalesce(context, F.lit("")), " "), 1, words), " ")
    return F.struct((seconds > long).alias("long"), F.when(seconds > long, F.concat(cut, F.lit("\n\nQuestion: "), question)).otherwise(question).alias("prompt"))


def common_columns(frames: Sequence[DataFrame]) -> list[str]:
    """The columns that all have, in the first one's order."""
    return [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]


def united(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, over the columns that all have."""
    names = common_columns(frames)
    out = frames[0].select(*names)
    for f in frames[1:]:
        out = out.unionByName(f.select(*names))
    return out


def by_split(sets: dict[str, dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """{split: rows} of {dataset: {split: rows}}; training rows are united, another split may have one dataset only."""
    grouped: dict[str, list[DataFrame]] = {}
    for name, splits in sets.items():
        for split, rows in splits.items():
            grouped.setdefault(split, []).append(rows.withColumn("dataset", F.lit(name)))
    for split, frames in grouped.items():
        if split != "train" and len(frames) > 1:
            raise ValueError(f"only one dataset may have the split {split}")
    return {split: united(frames) for split, frames in grouped.items()}


def split_sizes(rows: DataFrame) -> DataFrame:
    """(split, n): rows of each split."""
    return rows.groupBy("split").agg(F.count("*").alias("n"))


def shot_text(question: Column, answer: Column, context: Column | None = None) -> Column:
    """One example of a few-shot prompt: context if any, question, answer; a null answer leaves its place open."""
    head = F.concat(F.lit("Context: "), context, F.lit("\n")) if context is not None else F.lit("")
    return F.concat(F.when(F.coalesce(context, F.lit("")) != "", head).otherwise("") if context is not None else F.lit(""), F.lit("Q: "), question, F.lit("\nA:"), F.coalesce(F.concat(F.lit(" "), answer), F.lit("")))


def masked_difference(a: Column, b: Column) -> Column:
    """Where exactly one of two masks is set."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
