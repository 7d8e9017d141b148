"""Parts that a configuration names: text processors, and tasks, which join predictions to samples and score them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotloom.functions import text as T
from plotloom.operators import metrics as M
from plotloom.operators import vqa as V
from plotloom.sources.registry import REGISTRY

for _name, _part in {
    "caption": T.caption_clean, "alphanumeric": T.alnum_clean, "collapse": T.collapse, "punctuation": T.punctuation, "digits_articles": T.digits_articles, "answer_letter": T.answer_letter,
    "answer": lambda text: T.digits_articles(T.punctuation(T.collapse(text))),
}.items():
    REGISTRY.register("processor", _name)(_part)


def processor(name: str) -> Callable[[Column], Column]:
    """A function on text columns by its name; KeyError if there is none."""
    found = REGISTRY.get(f"processor.{name}")
    if found is None:
        raise KeyError(f"no processor {name}; there are {', '.join(REGISTRY.names('processor'))}")
    return found


def processed(rows: DataFrame, steps: dict[str, Sequence[str]]) -> DataFrame:
    """The rows with each column put through the processors of its list, one after another."""
    out = rows
    for column, names in steps.items():
        value = F.col(column)
        for name in names:
            value = processor(name)(value)
        out = out.withColumn(column, value)
    return out


@dataclass(frozen=True)
class Task:
    """How predictions of a kind are scored: ``key`` joins them to samples, ``score`` aggregates the joined rows.

    ``missing`` says what a sample without a prediction is: "wrong" keeps it with a null prediction, "error" refuses the run.
    """

    name: str
    key: str
    score: Callable[[DataFrame, Sequence[str]], DataFrame]
    missing: str = "wrong"

    def evaluate(self, samples: DataFrame, predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """Scores of predictions (key, prediction) over samples (key, answer, *by), in all or for each of ``by``; of repeated predictions of a key the first by text counts."""
        one = predictions.groupBy(self.key).agg(F.min("prediction").alias("prediction"))
        rows = samples.join(one, self.key, "left")
        if self.missing == "error":
            rows = rows.withColumn("prediction", F.when(F.col("prediction").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), F.col(self.key).cast("string")))).otherwise(F.col("prediction")))
        return self.score(rows, by)


def _exact(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    hit = F.coalesce(F.col("prediction") == F.col("answer"), F.lit(False))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(F.avg(hit.cast("int")), 6).alias("accuracy"))


def _classes(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return M.class_metrics(rows.withColumn("prediction", F.coalesce("prediction", F.lit("-1"))), "answer", "prediction", by)


def _bleu(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        raise ValueError("captions are scored in all")
    each = V.sentence_bleu(rows.select("question_id", F.coalesce("prediction", F.lit("")).alias("guess"), F.col("answer").alias("reference")), "question_id")
    return each.agg(F.count("*").alias("n"), *(F.round(F.avg(f"bleu{k}"), 6).alias(f"bleu{k}") for k in range(1, 5)))


for _task in (Task("exact_match", "question_id", _exact), Task("strict_exact_match", "question_id", _exact, "error"), Task("multiple_choice", "question_id", _classes), Task("captioning", "question_id", _bleu)):
    REGISTRY.register("task", _task.name)(_task)


def task(name: str) -> Task:
    """A task by its name; KeyError if there is none."""
    found = REGISTRY.get(f"task.{name}")
    if found is None:
        raise KeyError(f"no task {name}; there are {', '.join(REGISTRY.names('task'))}")
    return found
