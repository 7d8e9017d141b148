"""Queries of sinks and scans: a table is written in one of the formats, in the shared folder, and read back by its scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotloom.operators import orders, states, subtitles
from plotloom.plans.catalogue import _METRICS
from plotloom.plans.media import _CUES, cues
from plotloom.plans.registry import query
from plotloom.sources import archives, json_ranges, readers, scans, writers
from plotloom.sources.commits import ResultStore
from plotloom.sources.scratch import scratch
from plotloom.streaming import windows


@query("SELECT doc_id, lang, source, n_chars, md5(coalesce(text, '')) digest FROM documents WHERE doc_id % 10 <> 3")
def tar_shards(t):
    """Documents as samples of tar archives, a tenth of them without their second member, which therefore are no samples."""
    docs = t("documents")
    place = scratch(docs.sparkSession, "shards")
    body = F.to_json(F.struct("doc_id", "lang", "source", "n_chars", "text"))
    ends = F.when(F.col("doc_id") % 10 == 3, F.create_map(F.lit("json"), body)).otherwise(F.create_map(F.lit("json"), body, F.lit("jpg"), F.lit("x")))
    archives.write_shards(docs.select(F.concat(F.lit("d"), "doc_id").alias("sample"), F.explode(ends).alias("ending", "content")), place, 500).collect()  # a row an archive
    found = archives.shards(docs.sparkSession, place, "doc_id:long,lang:string,source:string,n_chars:long,text:string", 1 << 20)
    return found.select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def _committed(rows, make, name: str):
    """The states of three disjoint parts of the rows, each a commit of its own, the second one tried twice."""
    store = ResultStore(rows.sparkSession, scratch(rows.sparkSession, name))
    for part in (0, 1, 1, 2):
        store.append(make(rows.where(F.col("doc_id") % 3 == part)), f"part{part}")
    return store.read()


@query("WITH base AS (SELECT lang, quality::VARCHAR t, toxic::VARCHAR p FROM labels JOIN documents USING (doc_id))" + _METRICS.format(k="lang,", g="GROUP BY lang"))
def merged_metrics(t):
    rows = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    return states.confusion_scores(_committed(rows, lambda own: states.confusion_state(own, "quality", "toxic", ["lang"]), "states"), ["lang"])


@query("SELECT lang, 'n_chars' AS value, count(n_chars) n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) deviation, min(n_chars)::DOUBLE low, max(n_chars)::DOUBLE high FROM documents GROUP BY lang")
def merged_moments(t):
    rows = t("documents").select("doc_id", "lang", "n_chars")
    return states.moment_scores(_committed(rows, lambda own: states.moment_state(own, ["n_chars"], ["lang"]), "states"), ["lang"])


@query("SELECT o_custkey, arg_min(o_orderkey, (batch, o_orderdate, o_orderkey)) AS o_orderkey FROM (SELECT *, o_orderkey % 3 AS batch FROM orders) GROUP BY 1")
def committed_results(t):
    """Three writers after another, each with the first order of a customer; a customer's row is that of the first writer that has one."""
    rows = t("orders").select("o_custkey", "o_orderkey", "o_orderdate")
    store = ResultStore(rows.sparkSession, scratch(rows.sparkSession, "results"))
    for batch in range(3):
        store.append(rows.where(F.col("o_orderkey") % 3 == batch), f"rank{batch}", ["o_custkey"], ["o_orderdate", "o_orderkey"])
    store.compact()
    return store.read().select("o_custkey", "o_orderkey")


@query("SELECT event_id, count(*) OVER w AS n, quantile_disc(value, 0.5) OVER w AS median, round(avg(value) OVER w, 9) AS mean, max(value) OVER w AS highest, value AS latest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def streamed_look_back(t):
    """Events replayed through a stream, six days a batch, a seventh of them a batch late; a row in the far future lets the watermark pass the last ones."""
    events = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    spark = events.sparkSession
    place, schema = scratch(spark, "replay"), "event_id long, ts timestamp, user_id long, value double"
    batch = F.floor(F.dayofmonth("ts") / 6) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    parts = spark.sparkContext.defaultParallelism  # files of a batch, which come at a time
    for b in range(7):
        events.where(batch == b).repartition(parts).write.mode("append").parquet(f"{place}/in")
    events.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit(0.0).alias("value")).coalesce(1).write.mode("append").parquet(f"{place}/in")
    live = windows.stream(windows.timed_session(spark), f"{place}/in", schema, parts)
    rows = windows.rows_in_order(live, "user_id", "event_id", "value", late="13 days", forget="400 days")
    rows.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("key long, id long, ts timestamp, n long, median double, mean double, highest double, latest double").parquet(f"{place}/out")
    return found.where("id >= 0").select(F.col("id").alias("event_id"), "n", "median", F.round("mean", 9).alias("mean"), "highest", "latest")


@query("SELECT epoch::INT AS epoch, count(*) n, count(DISTINCT doc_id) AS documents, 0::BIGINT AS far FROM documents, range(0, 2) r(epoch) GROUP BY 1")
def buffered_shuffle(t):
    """Documents through a buffer of 500 rows, twice; far counts rows that moved by as many places, of which there must be none."""
    own = t("documents").select("doc_id").withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = orders.shuffle_buffer(own, 500, seed=5, epochs=2)
    return rows.groupBy("epoch").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"), F.count_if(F.abs(F.col("place") - F.col("at")) >= 500).alias("far"))


@query(None)
def interleaved_documents(t):
    """Documents of three sources, 3 to 1 to 2, until all have ended; held by a test against a plain loop."""
    return orders.interleaved(t("documents").select("doc_id", "source"), "source", ["doc_id"], {"src0": 3, "src1": 1, "src2": 2})


def _filed(t, start: str, each, between: str, end: str) -> tuple:
    """(session, folder): documents as JSON files of up to 500 rows, each of which ``each`` makes text, by doc_id, between ``start`` and ``end``."""
    docs = t("documents")
    place = scratch(docs.sparkSession, "json")
    rows = docs.groupBy(F.floor(F.col("doc_id") / 500).alias("f")).agg(F.array_sort(F.collect_list(F.struct("doc_id", each.alias("x")))).alias("rows"))
    text = F.concat(F.lit(start), F.array_join(F.transform("rows", lambda r: r["x"]), between), F.lit(end))
    writers.write_texts(rows.select(F.concat("f", F.lit(".json")).alias("file"), text.alias("text")), place)
    return docs.sparkSession, place


_ROW = ("doc_id", "lang", "source", "n_chars", "text")
_FIELDS = "doc_id:long,lang:string,source:string,n_chars:long,text:string"
_DIGEST = "md5(coalesce(text, '')) digest"


def _digested(rows, *keep: str):
    return rows.select(*keep, "doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query(f"SELECT (doc_id // 500) || '.json#' || (row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) - 1) instance_id, doc_id, lang, source, n_chars, {_DIGEST} FROM documents")
def json_lists(t):
    """Documents as JSON lists, each read whole, numbered by file."""
    spark, place = _filed(t, "[", F.to_json(F.struct(*_ROW)), ",\n", "]")
    return _digested(scans.annotations(spark, place, _FIELDS), "instance_id")


@query(f"SELECT (row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) - 1)::BIGINT AS number, doc_id, lang, source, n_chars, {_DIGEST} FROM documents")
def json_by_ranges(t):
    """Documents as lists inside of objects, read by ranges of 64 KB."""
    spark, place = _filed(t, '{"info": {"qa_pairs": []}, "qa_pairs": [', F.to_json(F.struct(*_ROW)), ", ", '], "end": "]"}')
    rows = json_ranges.elements(spark, place, "qa_pairs", 1 << 16)
    return _digested(rows.select("number", F.from_json("body", f"struct<{_FIELDS}>").alias("a")).select("number", "a.*"), "number")


@query(f"SELECT (row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) - 1)::INT AS pos, 'k' || doc_id AS key, doc_id, lang, source, n_chars, {_DIGEST} FROM documents")
def json_objects(t):
    """Documents as objects of objects, with their keys."""
    spark, place = _filed(t, "{", F.concat(F.lit('"k'), F.col("doc_id"), F.lit('": '), F.to_json(F.struct(*_ROW))), ",\n", "}")
    return _digested(scans.keyed(spark, place, _FIELDS), "pos", "key")


@query(f"SELECT doc_id, lang, source, n_chars, {_DIGEST} FROM documents")
def json_lines(t):
    docs = t("documents")
    place = scratch(docs.sparkSession, "lines")
    writers.write_json(docs.select(*_ROW), place)
    return _digested(scans.lines(docs.sparkSession, place, _FIELDS))


@query("SELECT vec_id::INT AS pos, 'doc__' || vec_id doc_key, label::VARCHAR AS text, embedding[1]::DOUBLE AS first, embedding[len(embedding)]::DOUBLE AS last, len(embedding)::INT AS size FROM embeddings")
def vector_store(t):
    rows = t("embeddings").select(F.col("vec_id").cast("int").alias("pos"), F.concat(F.lit("doc__"), "vec_id").alias("doc_key"), F.col("label").cast("string").alias("text"), "embedding")
    place = scratch(rows.sparkSession, "vectors")
    writers.write_vectors(rows, place)
    e = F.col("embedding")
    return scans.vectors(rows.sparkSession, place).select("pos", "doc_key", "text", F.get(e, 0).cast("double").alias("first"), F.element_at(e, -1).cast("double").alias("last"), F.size(e).alias("size"))


@query(_CUES + " SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY start_s, pos) - 1)::INT AS pos, floor(start_s * 1000 + 0.000001) / 1000 AS start_s, floor(end_s * 1000 + 0.000001) / 1000 AS end_s, text FROM c")
def subtitle_files(t):
    """A WebVTT file of each video, written and read back as cues."""
    rows = cues(t)
    place = scratch(rows.sparkSession, "subtitles")
    writers.write_texts(subtitles.whole_vtt(rows).select(F.concat("video_id", F.lit(".vtt")).alias("file"), F.col("vtt").alias("text")), place)
    return readers.cues(rows.sparkSession, place).select("video_id", F.col("pos").cast("int").alias("pos"), "start_s", "end_s", "text")


@query("SELECT row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) - 1 AS pos, 'd' || doc_id doc_key, coalesce(text, '') AS text FROM documents")
def document_maps(t):
    """Objects of texts by key, as a clip memory keeps them."""
    whole = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t")))
    entry = F.concat(F.lit('"d'), F.col("doc_id"), F.lit('": '), F.substr(whole, F.lit(6), F.length(whole) - 6))
    spark, place = _filed(t, "{", entry, ", ", "}")
    return scans.document_map(spark, place).select(F.col("pos").cast("long").alias("pos"), "doc_key", "text")


@query("SELECT 'q' || doc_id question_id, source || ' or not?' question, array_to_string([lang, source], '|') AS options, (doc_id % 4)::INT answer_index, (row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) - 1)::INT AS pos FROM documents")
def question_files(t):
    """Files of questions inside of ``qa_dataset``."""
    made = F.struct(F.concat(F.lit("q"), "doc_id").alias("question_id"), F.concat("source", F.lit(" or not?")).alias("question"), F.array("lang", "source").alias("options"), (F.col("doc_id") % 4).alias("answer_index"))
    spark, place = _filed(t, '{"qa_dataset": [', F.to_json(made), ", ", "]}")
    return readers.questions(spark, place).select("question_id", "question", F.array_join("options", "|").alias("options"), F.col("answer_index").cast("int").alias("answer_index"), F.col("pos").cast("int").alias("pos"))


@query("SELECT 'p' || (doc_id // 500) data_id, count(*) n_steps, sum(doc_id)::BIGINT total FROM documents GROUP BY 1")
def episode_folders(t):
    """A folder for each 500 documents with one JSON file, as navigation episodes lie."""
    docs = t("documents")
    place = scratch(docs.sparkSession, "folders")
    held = docs.groupBy(F.floor(F.col("doc_id") / 500).alias("f")).agg(F.array_sort(F.collect_list("doc_id")).alias("path"), F.count("*").alias("n_steps"))
    writers.write_texts(held.select(F.concat(F.lit("p"), "f", F.lit("/data.json")).alias("file"), F.to_json(F.struct("path", "n_steps")).alias("text")), place)
    rows = scans.folders(docs.sparkSession, place, "path:array<long>,n_steps:long")
    return rows.select("data_id", "n_steps", F.aggregate("path", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT 'v' || user_id video_id, 'en' AS extension FROM events GROUP BY user_id")
def subtitle_index(t):
    """Which videos have a subtitle file, from names alone."""
    rows = t("events").select(F.concat(F.lit("v"), "user_id", F.lit(".en.vtt")).alias("file"), F.lit("WEBVTT\n").alias("text")).distinct()
    place = scratch(rows.sparkSession, "names")
    writers.write_texts(rows, place)
    return scans.availability(rows.sparkSession, place)


@query("SELECT doc_id * 3 AS ref_id, doc_id || '.jpg' AS file_name, (doc_id % 640)::INT width, n_chars::DOUBLE area, lang || '|' || source AS refers FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 7 <> 0")
def referred_regions(t):
    """Object files and reference files of documents: a quarter of the references is of another split, and a seventh of the regions is missing."""
    docs = t("documents")
    place, half = scratch(docs.sparkSession, "objects"), F.floor(F.col("doc_id") / 500).alias("f")
    image = F.struct(F.col("doc_id").alias("id"), F.concat("doc_id", F.lit(".jpg")).alias("file_name"), (F.col("doc_id") % 640).cast("int").alias("width"), F.lit(480).alias("height"))
    note = F.when(F.col("doc_id") % 7 != 0, F.struct((F.col("doc_id") * 2).alias("id"), F.col("doc_id").alias("image_id"), F.lit(1).alias("category_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("bbox"), F.col("n_chars").cast("double").alias("area")))
    held = docs.groupBy(half).agg(F.to_json(F.struct(F.collect_list(image).alias("images"), F.collect_list(note).alias("annotations"))).alias("text"))
    writers.write_texts(held.select(F.concat("f", F.lit(".json")).alias("file"), "text"), place)
    said = F.struct((F.col("doc_id") * 3).alias("ref_id"), (F.col("doc_id") * 2).alias("ann_id"), F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train").alias("split"), F.array(F.struct(F.col("lang").alias("sent")), F.struct(F.col("source").alias("sent"))).alias("sentences"))
    spark, refers = _filed(t, "[", F.to_json(said), ", ", "]")
    return scans.refer_regions(spark, place, refers).select("ref_id", "file_name", "width", "area", F.array_join("refers", "|").alias("refers"))
