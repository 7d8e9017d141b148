"""Readers of script pages, episodes, question files, result trees and subtitles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotloom.functions.text import paragraphs, question_kept, title

TURN = "struct<speaker:string,text:string>"
EVENT = "struct<event_id:string,event_description:string,involved_subjects:array<string>,location:string,timestamp:string,episode_clip:string>"
SCENE = f"struct<scene_description:string,dialogue:array<{TURN}>,context_label:string,location:string,subjects:array<string>,event_description:string,clip_start:string,clip_end:string,srt_start:string,srt_end:string,events:array<{EVENT}>>"
EPISODE = f"episode string, title string, scenes array<{SCENE}>"
QUESTION = "question_id:string,question_type:string,subcategory:string,cues:string,target:string,question:string,options:array<string>,answer:string,answer_index:int,explanation:string,related_events:array<string>,episode_span:array<string>,clip_span:array<string>"
RESULT = f"struct<{QUESTION},result:struct<model:string,model_response:string,execution_time:string,ground_truth_answer:string,error:string>>"


def episodes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each episode file (a JSON object)."""
    return spark.read.schema(EPISODE).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def script_pages(spark: SparkSession, path: str) -> DataFrame:
    """(stem, title, paragraphs) of the .html files whose name starts with four digits."""
    text = spark.read.option("pathGlobFilter", "*.html").text(path, wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.html$", 1)
    return text.select(stem.alias("stem"), title(F.col("value")).alias("title"), paragraphs(F.col("value")).alias("paragraphs")).where(F.col("stem").rlike(r"^\d{4}"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of question or result files, whether a file is a list or an object that holds ``qa_dataset``."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    listed = F.from_json("value", f"array<{RESULT}>")
    inner = F.from_json("value", f"struct<qa_dataset:array<{RESULT}>>")["qa_dataset"]
    rows = F.when(F.ltrim("value").startswith("["), listed).otherwise(inner)
    return text.select("path", F.posexplode(rows).alias("pos", "q")).select("path", "pos", "q.*")


def kept_questions(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """The rows of ``questions`` that an evaluation keeps, without the first ``skip`` of all (by file and place), which a checkpoint has done."""
    rows = questions(spark, path)
    if skip:
        rows = rows.orderBy("path", "pos").offset(skip)
    empty = F.array().cast("array<string>")
    return rows.where(question_kept(F.coalesce("question", F.lit("")), F.coalesce("options", empty), F.coalesce("answer_index", F.lit(-1))))


def result_key(path):
    """(model, run, context, nn) columns from a result file's path; rows of other folders have a null context."""
    plain = lambda k: F.regexp_extract(path, r"results_[^/]+/([^/]+)/(with_context|without_context)/(run_[^/]+)/[^/]+\.json$", k)
    ranked = lambda k: F.regexp_extract(path, r"results_[^/]+/([^/]+)/(run_[^/]+)/([^/]+)/([^/]+)/[^/]+\.json$", k)
    is_plain = plain(1) != ""
    kind = ranked(3)
    context = F.when(is_plain, plain(2)).when(kind.contains("generic"), "without_context").when(kind.contains("specific"), "with_context")
    return F.when(is_plain, plain(1)).otherwise(ranked(1)).alias("model"), F.when(is_plain, plain(3)).otherwise(ranked(2)).alias("run"), context.alias("context"), F.when(is_plain, F.lit("vanilla")).otherwise(ranked(4)).alias("nn")


def cues(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, pos, start_s, end_s, text) of .vtt and .srt files."""
    text = spark.read.option("pathGlobFilter", "*.{vtt,srt}").text(path, wholetext=True)
    clock = r"(?:(\d+):)?(\d+):(\d+)[.,](\d+)"
    block = F.split(F.replace("value", F.lit("\r"), F.lit("")), "\n\n+")
    rows = text.select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("video_id"), F.posexplode(F.filter(block, lambda b: b.contains("-->"))).alias("pos", "b"))

    def at(k: int):
        part = lambda i: F.coalesce(F.regexp_extract("b", rf"{clock}\s*-->\s*{clock}", k + i).try_cast("double"), F.lit(0.0))
        return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000

    lines = F.split("b", "\n")
    after = F.slice(lines, F.array_position(F.transform(lines, lambda x: x.contains("-->")), True) + 1, F.size(lines))
    words = F.trim(F.array_join(after, " "))
    return rows.select("video_id", "pos", at(0).alias("start_s"), at(4).alias("end_s"), words.alias("text"))


def keyed_objects(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(key, value) of a JSON object of objects, in file order by pos."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.map_entries(F.from_json("value", f"map<string,{value_schema}>"))).alias("pos", "e")).select("pos", "e.key", "e.value")
