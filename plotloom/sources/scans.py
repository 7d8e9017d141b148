"""Scans of annotation files: lists, enveloped lists, keyed objects, lines, nested lists, folders, tables; archives are in ``archives``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotloom.sources.archives import archive_members, shards  # noqa: F401  scans like the others
from plotloom.sources.json_ranges import elements, keyed_body
from plotloom.sources.scratch import store_of


#: A JSON file up to so many bytes is parsed as one text; a larger one is read in ranges of so many.
WHOLE, RANGE = 256 << 20, 32 << 20


def _texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.text([paths] if isinstance(paths, str) else list(paths), wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def _large(spark: SparkSession, paths: str | Sequence[str]) -> tuple[list[str], list[str]]:
    """(files that can be parsed as one text, files that are too large for that); by their sizes alone."""
    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths)).select("path", "length").collect()  # a row a file
    return [r.path for r in files if r.length <= WHOLE], [r.path for r in files if r.length > WHOLE]


def _first_mark(path: str) -> str:
    store, place = store_of(path)
    with store.open_input_file(place) as f:
        return next((chr(c) for piece in iter(lambda: f.read(4096), b"") for c in piece.lstrip(b"\xef\xbb\xbf \t\r\n")[:1]), "")


def annotations(spark: SparkSession, paths: str | Sequence[str], schema: str, field: str = "annotations") -> DataFrame:
    """(instance_id, *schema) of JSON files that are lists, or objects whose ``field`` is one; each parsed once, a file of over ``WHOLE`` bytes in ranges.

    instance_id is a row's number from 0, as text; of several files each row has its file's name before the number.
    """
    small, large = _large(spark, paths)
    listed = F.from_json("value", f"array<struct<{schema}>>")
    inner = F.from_json("value", f"struct<`{field}`:array<struct<{schema}>>>")[field]
    rows = None
    if small or not large:
        rows = _texts(spark, small or paths).select("path", F.posexplode(F.when(F.ltrim("value").startswith("["), listed).otherwise(inner)).alias("pos", "a"))
    for path in large:
        one = elements(spark, path, None if _first_mark(path) == "[" else field, RANGE).select("path", F.col("number").alias("pos"), F.from_json("body", f"struct<{schema}>").alias("a"))
        rows = one if rows is None else rows.unionByName(one)
    single = isinstance(paths, str) and paths.endswith(".json")
    number = F.col("pos").cast("string") if single else F.concat_ws("#", F.element_at(F.split("path", "/"), -1), F.col("pos").cast("string"))
    return rows.select(number.alias("instance_id"), "a.*")


def enveloped(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The rows of the list under ``field`` of a JSON object, with their places."""
    if _large(spark, path)[1]:
        return elements(spark, path, field, RANGE).select(F.col("number").cast("int").alias("pos"), F.from_json("body", f"struct<{schema}>").alias("a")).select("pos", "a.*")
    return _texts(spark, path).select(F.posexplode(F.from_json("value", f"struct<`{field}`:array<struct<{schema}>>>")[field]).alias("pos", "a")).select("pos", "a.*")


def keyed(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """(pos, key, *schema) of a JSON object of objects, or of the one under ``field``; in file order."""
    if _large(spark, path)[1]:
        key, value = keyed_body(F.col("body"), schema)
        return elements(spark, path, field, RANGE).select(F.col("number").cast("int").alias("pos"), key.alias("key"), value.alias("a")).select("pos", "key", "a.*")
    value = F.from_json("value", f"map<string,struct<{schema}>>") if field is None else F.from_json("value", f"struct<`{field}`:map<string,struct<{schema}>>>")[field]
    return _texts(spark, path).select(F.posexplode(F.map_entries(value)).alias("pos", "e")).select("pos", "e.key", "e.value.*")


def lines(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """One row for each JSON line."""
    text = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    return text.select(F.from_json("value", f"struct<{schema}>").alias("a")).select("a.*")


def nested(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a list of lists."""
    return _texts(spark, path).select(F.explode(F.flatten(F.from_json("value", f"array<array<struct<{schema}>>>"))).alias("a")).select("a.*")


def folders(spark: SparkSession, path: str, schema: str, name: str = "data.json") -> DataFrame:
    """(data_id, *schema) of the JSON file of that name in each folder below ``path``; data_id is the folder."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path, wholetext=True)
    place = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return text.select(place.alias("data_id"), F.from_json("value", f"struct<{schema}>").alias("a")).select("data_id", "a.*")


def vqa_pair(spark: SparkSession, annotation_path: str, question_path: str) -> tuple[DataFrame, DataFrame]:
    """(annotations, questions) of the two files of a question set."""
    notes = annotations(spark, annotation_path, "question_id:long,image_id:long,question_type:string,answer_type:string,answers:array<struct<answer_id:int,answer:string>>")
    asked = enveloped(spark, question_path, "questions", "question_id:long,image_id:long,question:string,multiple_choices:array<string>")
    return notes.withColumnRenamed("instance_id", "pos"), asked


SPLITS = ("train", "val", "test", "test_w_ans")


def split_path(folder: str, split: str, version: str = "v1p0") -> str:
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    return f"{folder.rstrip('/')}/aokvqa_{version}_{split}.json"


def instances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of object files: images (image_id, file_name, width, height), annotations (ann_id, image_id, category_id, bbox, area)."""
    images = enveloped(spark, path, "images", "id:long,file_name:string,width:int,height:int").withColumnRenamed("id", "image_id").drop("pos")
    notes = enveloped(spark, path, "annotations", "id:long,image_id:long,category_id:long,bbox:array<double>,area:double").withColumnRenamed("id", "ann_id").drop("pos")
    return images, notes


def refer_regions(spark: SparkSession, objects: str, refers: str, split: str | None = "train") -> DataFrame:
    """(ref_id, file_name, width, height, bbox, area, split, refers): what people call the regions of a split, with the region and its image.

    ``refers`` are JSON lists of (ref_id, ann_id, split, sentences), as the original's pickles are not read; ``objects`` are files of ``instances``. A
    reference to a region or an image that isn't there gives no row.
    """
    images, notes = instances(spark, objects)
    said = annotations(spark, refers, "ref_id:long,ann_id:long,split:string,sentences:array<struct<sent:string>>").drop("instance_id")
    said = said if split is None else said.where(F.col("split") == split)
    rows = said.join(notes, "ann_id").join(images, "image_id")
    return rows.select("ref_id", "file_name", "width", "height", "bbox", "area", "split", F.transform("sentences", lambda s: s["sent"]).alias("refers"))


def strokes(spark: SparkSession, path: str, tag: str = "") -> DataFrame:
    """(image_id, strokes, tag) of JSON objects of stroke lists by image, each stroke a list of numbers."""
    text = _texts(spark, path)
    return text.select(F.explode(F.from_json("value", "map<string,array<array<double>>>")).alias("image_id", "strokes")).select("image_id", "strokes", F.lit(tag).alias("tag"))


def availability(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, extension) of a folder's files, without reading them: what stands before the first '.', and the piece after it."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    parts = F.split("name", r"\.")
    return files.select(F.get(parts, 0).alias("video_id"), F.get(parts, 1).alias("extension")).dropDuplicates(["video_id"])


def existing(rows: DataFrame, files: DataFrame, name: Column) -> DataFrame:
    """The rows whose file (by name, without folders) is among ``files`` (name)."""
    return rows.withColumn("_n", name).join(files.select(F.col("name").alias("_n")).distinct(), "_n", "left_semi").drop("_n")


def show_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, pos, start_s, end_s, text) of a list of videos with their subtitles."""
    rows = annotations(spark, path, "vid_name:string,sub:array<struct<start:double,end:double,text:string>>")
    return rows.select(F.col("vid_name").alias("video_id"), F.posexplode("sub").alias("pos", "s")).select("video_id", "pos", F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), F.col("s.text").alias("text"))


def files_in_order(spark: SparkSession, folder: str, schema: str, most: int = 0, pattern: str = "*.json") -> DataFrame:
    """(file, *schema): a JSON object of each file, the first ``most`` files by name; 0 means all."""
    text = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    if most:
        names = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file")).orderBy("file").limit(most)
        text = text.join(names, "file", "left_semi")
    return text.select("file", F.from_json("value", f"struct<{schema}>").alias("a")).select("file", "a.*")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(pos, doc_key, text, embedding) that ``writers.write_vectors`` stored; never a pickle."""
    return spark.read.parquet(path)


def document_map(spark: SparkSession, path: str) -> DataFrame:
    """(pos, doc_key, text) of a JSON object of texts, in file order."""
    return _texts(spark, path).select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("pos", "e")).select("pos", F.col("e.key").alias("doc_key"), F.col("e.value").alias("text"))


def by_extension(spark: SparkSession, path: str) -> DataFrame:
    """A table of a .txt (value), .json, .jsonl, .csv or .parquet file; others raise ValueError, pickled ones too, as they run code."""
    end = path.rsplit(".", 1)[-1].lower()
    if end == "txt":
        return spark.read.text(path)
    if end == "json":
        return spark.read.option("multiLine", True).json(path)
    if end in ("jsonl", "ndjson"):
        return spark.read.json(path)
    if end == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if end == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for .{end}")


def merged_config(*layers: dict) -> dict:
    """Nested settings, each layer over those before; dotted keys reach inside, and '' means unset."""
    out: dict = {}

    def put(into: dict, key: str, value) -> None:
        head, _, rest = key.partition(".")
        if rest:
            put(into.setdefault(head, {}), rest, value)
        elif isinstance(value, dict):
            for k, v in value.items():
                put(into.setdefault(head, {}), k, v)
        elif value != "":
            into[head] = value

    for layer in layers:
        for key, value in layer.items():
            put(out, key, value)
    return out
