"""Writers of results, texts, vectors and logs, which never redo what is there unless asked."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotloom.sources.scratch import store_of, stored


def pending(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys aren't done yet."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("model", "context", "run", "nn").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_json(rows: DataFrame, path: str, overwrite: bool = True) -> bool:
    """One JSON object a line, UTF-8; whether it was written. What is there stays unless ``overwrite``."""
    if not overwrite and exists(rows.sparkSession, path):
        return False
    rows.write.mode("overwrite").json(path)
    return True


def pretty(value: Column) -> Column:
    """A struct or array as indented JSON text."""
    return F.to_json(value, {"pretty": "true"})


def write_texts(rows: DataFrame, folder: str, name: str = "file", text: str = "text", overwrite: bool = True) -> DataFrame:
    """Writes a file for each row under ``folder``, from the task that holds it; returns (file, written), False where one was there and stays.

    The folder is a path that all executors share, or an address of a store that Arrow knows.
    """
    spark = rows.sparkSession

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(folder.rstrip("/"))
        store.create_dir(root, recursive=True)
        for f in frames:
            done = []
            for n, body in zip(f[name], f[text], strict=True):
                path = f"{root}/{n}"
                fresh = overwrite or store.get_file_info(path).type == FileType.NotFound
                if fresh:
                    if "/" in n:
                        store.create_dir(path.rpartition("/")[0], recursive=True)
                    part = f"{path}.{uuid.uuid4().hex}.part"  # whole or not at all, also if the task is run again
                    with store.open_output_stream(part) as out:
                        out.write(body.encode())
                    store.move(part, path)
                done.append((n, fresh))
            yield pd.DataFrame(done, columns=["file", "written"])

    found = rows.select(F.col(name), F.col(text)).mapInPandas(put, "file string, written boolean").collect()  # a row a file
    return spark.createDataFrame([tuple(r) for r in found], "file string, written boolean")


def write_episodes(rows: DataFrame, path: str) -> None:
    """Annotated episodes, a folder for each."""
    rows.write.mode("overwrite").partitionBy("episode").json(path)


def skip_named(work: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """The rows whose key no file name (``name``) holds between underscores."""
    keys = files.select(F.explode(F.split("name", "_")).alias(key)).distinct()
    return work.join(keys, key, "left_anti")


def done_stems(files: DataFrame, suffix: str = "_with_events") -> DataFrame:
    """(stem) of the file names (``name``) that end in the suffix and .json."""
    stem = F.regexp_extract("name", rf"^(.*){suffix}\.json$", 1)
    return files.select(stem.alias("stem")).where("stem <> ''").distinct()


def merged_ranks(rows: DataFrame, key: str) -> DataFrame:
    """Of rows (rank, pos, ...) of several processes the first of each key, by rank and place."""
    order = F.row_number().over(Window.partitionBy(key).orderBy("rank", "pos"))
    return rows.withColumn("_rn", order).where("_rn = 1").drop("_rn")


def append_store(rows: DataFrame, path: str) -> None:
    """Adds rows to a store by its extension: .json, .jsonl, .csv, .parquet; others raise ValueError."""
    end = path.rstrip("/").rsplit(".", 1)[-1]
    if end in ("json", "jsonl"):
        rows.select(*sorted(rows.columns)).write.mode("append").json(path)
    elif end == "csv":
        rows.write.mode("append").option("header", True).csv(path)
    elif end == "parquet":
        rows.write.mode("append").parquet(path)
    else:
        raise ValueError(f"no store for .{end}")


def write_vectors(rows: DataFrame, path: str) -> None:
    """(pos, doc_key, text, embedding) as a table."""
    rows.select("pos", "doc_key", "text", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def log_metrics(spark: SparkSession, metrics: dict[str, float], split: str, path: str) -> None:
    """Appends one JSON line whose keys start with the split's name."""
    names = sorted(metrics)
    spark.createDataFrame([tuple(float(metrics[n]) for n in names)], ", ".join(f"`{split}_{n}` double" for n in names)).coalesce(1).write.mode("append").json(path)


def leaderboard(rows: DataFrame, key: str = "question_id", value: str = "prediction") -> DataFrame:
    """(questionId, prediction) as texts."""
    return rows.select(F.col(key).cast("string").alias("questionId"), F.col(value).cast("string").alias("prediction"))


def answer_map(rows: DataFrame) -> DataFrame:
    """(question_id, json): each question's entry of the leaderboard map, with the answers that it has."""
    return rows.select("question_id", F.to_json(F.struct("multiple_choice", "direct_answer")).alias("json"))


def judge_until_done(results: DataFrame, scores: Callable[[DataFrame], DataFrame], before: DataFrame, key: str = "video_name", tries: int = 3) -> DataFrame:
    """(key, score): scores from before, and those of the rest by ``scores``, which is asked again for what it left out, ``tries`` times at most.

    What a try scored is written to the shared folder, so that no row is scored twice.
    """
    have = before.select(key, "score")
    for _ in range(tries):
        left = pending(results, have, [key])
        if left.isEmpty():
            break
        have = have.unionByName(stored(scores(left).where("score IS NOT NULL").select(key, "score"), "scores"))
    return have
