"""Queries of captions, instructions, boxes, frames, vectors, subtitles and retrieval, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotloom.functions import media as X
from plotloom.functions import numbers as N
from plotloom.operators import prefix as P
from plotloom.operators import relate as R
from plotloom.operators import subtitles as S
from plotloom.operators.table_functions import register
from plotloom.plans.registry import query

_POOL = ("look at {}", "what is {} ?", "{}")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, trunc(l_discount * 100)::INT x1, trunc(l_tax * 100)::INT y1, trunc(l_quantity)::INT w, '{<' || trunc(l_discount * 100)::INT || '><' || trunc(l_tax * 100)::INT || '><' || (trunc(l_discount * 100)::INT + trunc(l_quantity)::INT) || '><' || trunc(l_tax * 100)::INT || '>}' b FROM lineitem)
SELECT l_orderkey, l_linenumber, b box, 'a <p>cat</p> ' || b || '<delim>{<1>} near a dog' AS caption, CASE WHEN ('0x' || md5(l_orderkey || '|0')[1:8])::BIGINT < ('0x' || md5(l_orderkey || '|1')[1:8])::BIGINT THEN '{o,' || b || '}, {p,<2>}' ELSE '{p,<2>}, {o,' || b || '}' END objects FROM b""")
def grounded_texts(t):
    x1, y1, x2, y2 = N.grid_box(F.col("l_discount"), F.col("l_tax"), F.lit(0.0), F.lit(0.0))
    rows = t("lineitem").withColumn("box", N.box_text(x1, y1, x2 + F.col("l_quantity").cast("int"), y2))
    caption = X.grounded_caption(F.lit("a cat near a dog"), F.array(F.lit("cat"), F.lit("dog"), F.lit("cat")), F.array(F.col("box"), F.lit("{<9>}"), F.lit("{<1>}")))
    objects = X.object_list(F.array(F.lit("o"), F.lit("'p")), F.array(F.col("box"), F.lit(" <2>")), F.col("l_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "box", caption.alias("caption"), objects.alias("objects"))


@query("""SELECT item_id, '<Img><ImageHere></Img> ' || replace((['look at {}', 'what is {} ?', '{}'])[('0x' || md5(item_id::VARCHAR)[1:8])::BIGINT % 3 + 1], '{}', text) || ' ' AS instruction, text || ' because' AS before, 'b' AS after, 'do' || CASE WHEN item_id % 2 = 0 THEN ' short' ELSE '' END AS constrained, translate(text, '-:', '  ') AS caption FROM benchmark""")
def instructions(t):
    b = t("benchmark")
    before, after = X.rationale_parts(F.concat("text", F.lit(" because\nAnswer:a\nAnswer:b")))
    return b.select(
        "item_id", X.instruction(_POOL, F.col("item_id"), F.col("text")).alias("instruction"), before.alias("before"), after.alias("after"),
        X.constrained(F.lit("do"), F.when(F.col("item_id") % 2 == 0, "short")).alias("constrained"), X.video_caption(F.concat(F.lit("clip-12-x:"), F.translate("text", "-:", "  "))).alias("caption"),
    )


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 i FROM conversations)
SELECT conv_id, 'sys<s>' || string_agg(role || CASE WHEN turn % 7 = 0 THEN '' ELSE text END, '' ORDER BY turn) one, 'sys<s>' || string_agg(role || CASE WHEN turn % 7 = 0 THEN '' ELSE text || CASE WHEN i % 2 = 0 THEN '<s>' ELSE '</s>' END END, '' ORDER BY turn) two,
string_agg(CASE WHEN i = 0 THEN '<Img><ImageHere></Img> ' || trim(replace(text, chr(10), '')) || ' ' WHEN i % 2 = 0 THEN text END, '!@#' ORDER BY turn) asked, coalesce(string_agg(CASE WHEN i % 2 = 1 THEN text END, '!@#' ORDER BY turn), '') said FROM t GROUP BY 1""")
def conversation_prompts(t):
    held = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    turns = F.transform("x", lambda v: F.struct(v["role"].alias("role"), F.when(v["turn"] % 7 != 0, v["text"]).alias("message")))
    asked, said = X.turns_folded(F.transform("x", lambda v: v["text"]))
    return held.select("conv_id", X.conversation_text(F.lit("sys"), turns).alias("one"), X.conversation_text(F.lit("sys"), turns, two=True).alias("two"), asked.alias("asked"), said.alias("said"))


@query("""SELECT doc_id, array_to_string(list_transform(range(8), lambda i: trunc(greatest(0, 2) + (least(50, n_chars) - 2) / 8.0::DOUBLE / 2 + round_even((least(50, n_chars) - 2) / 8.0::DOUBLE * i, 0))::INT), ',') centres,
array_to_string(list_filter(range(n_chars::BIGINT), lambda i: i % greatest(1, n_chars // 6) = 0)[1:6], ',') AS every, array_to_string(list_concat([n_chars % 7, n_chars], list_transform(range(3), lambda i: n_chars)), ',') AS padded FROM documents WHERE n_chars > 2""")
def frame_places(t):
    n = F.col("n_chars")
    centres = N.bounded_centres(8, F.lit(2.0), n, first=0, start=1.0, end=25.0)
    return t("documents").where("n_chars > 2").select("doc_id", F.array_join(centres, ",").alias("centres"), F.array_join(N.every_kth(n, 6), ",").alias("every"), F.array_join(N.padded(F.array(n % 7, n), 5), ",").alias("padded"))


@query("SELECT event_id, count(*) OVER w AS so_many, (sum(value::DECIMAL(18, 2)) OVER w)::DOUBLE / count(*) OVER w AS so_far, (sum(value::DECIMAL(18, 2) * (event_id % 3)) OVER w)::DOUBLE / nullif(sum(event_id % 3) OVER w, 0)::DOUBLE weighted FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_global(t):
    n, value = F.col("event_id") % 3, F.col("value").cast("decimal(18,2)")
    rows = P.running(t("events"), ["ts", "event_id"], {"total": value, "heavy": value * n, "weight": n, "so_many": F.lit(1).cast("long")})
    return rows.select("event_id", "so_many", (F.col("total").cast("double") / F.col("so_many")).alias("so_far"), F.try_divide(F.col("heavy").cast("double"), F.col("weight")).alias("weighted"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings), m AS (SELECT vec_id, e, list_max(e) mx FROM v)
SELECT vec_id, round(exp(e[1] - mx) / list_sum(list_transform(e, lambda x: exp(x - mx))), 6) soft, round(e[2] / sqrt(list_dot_product(e, e)), 6) AS unit, round(e[3] + e[4], 6) added, round((e[1] + e[3]) / 2, 6) AS pooled FROM m""")
def vector_functions(t):
    e = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    tokens = F.array(*(F.slice("e", k, 2) for k in (1, 2, 3)))
    return e.select(
        "vec_id", F.round(F.get(N.softmax(F.col("e")), 0), 6).alias("soft"), F.round(F.get(N.unit(F.col("e")), 1), 6).alias("unit"), F.round(F.get(N.added(F.slice("e", 3, 1), F.slice("e", 4, 1)), 0), 6).alias("added"),
        F.round(F.get(N.pooled(tokens, F.array(F.lit(1.0), F.lit(0.0), F.lit(1.0))), 0), 6).alias("pooled"),
    )


@query("SELECT o_orderkey, round((0.1 - 0.01) * 0.5 * (1 + cos(pi() * (o_orderkey % 100) / 100.0)) + 0.01, 9) cosine, round(least(0.1::DOUBLE, 0.001::DOUBLE + 0.099::DOUBLE * (o_orderkey % 50) / 40.0), 9) warm, round(greatest(0.01::DOUBLE, 0.1::DOUBLE * power(0.9::DOUBLE, (o_orderkey % 30)::DOUBLE)), 9) AS step FROM orders")
def learning_rates(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", F.round(N.cosine_rate(k % 100, F.lit(100), 0.1, 0.01), 9).alias("cosine"), F.round(N.warm_rate(k % 50, F.lit(40), 0.001, 0.1), 9).alias("warm"), F.round(N.step_rate(k % 30, 0.1, 0.01, 0.9), 9).alias("step"))


@query("""SELECT page_id, regexp_matches(url, '^[hH][tT][tT][pP][sS]?://') web, regexp_matches(url, '^[A-Za-z0-9_]+://') AS scheme, 'v' || page_id video, page_id % 2 = 0 AS tube, CASE WHEN page_id % 2 = 0 THEN 'f' || page_id END drive, page_id % 3 <> 0 AS truth, round(length(html) / 1048576.0::DOUBLE, 9) mb, lpad(page_id::VARCHAR, 12, '0') || '.jpg' AS image FROM pages WHERE url IS NOT NULL""")
def addresses(t):
    k = F.col("page_id")
    tube = F.concat(F.when(k % 2 == 0, "https://www.youtube.com/watch?v=").otherwise("https://x.org/https://www.youtube.com/watch?v="), F.concat(F.lit("v"), k), F.lit("&t=1"))
    drive = F.concat(F.when(k % 2 == 0, "https://drive.google.com/file/d/f").otherwise("https://x.com/file/d/f"), k, F.lit("/view?x=1"))
    word = F.when(k % 3 == 0, "No").when(k % 3 == 1, "T").otherwise("YES")
    return t("pages").where("url IS NOT NULL").select(
        "page_id", X.is_web(F.col("url")).alias("web"), X.has_scheme(F.col("url")).alias("scheme"), X.youtube_id(tube).alias("video"), X.is_youtube(tube).alias("tube"), X.drive_id(drive).alias("drive"), X.truth_of(word).alias("truth"),
        F.round(X.megabytes(F.length("html")), 9).alias("mb"), X.image_file(k).alias("image"),
    )


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, [l_tax, l_discount, 0.5] s FROM lineitem) SELECT l_orderkey, l_linenumber, '[coarse]0(' || trunc(l_tax * 255)::INT || ',' || trunc(l_discount * 255)::INT || ');1(127,255)' strokes, '(' || trunc(l_quantity)::INT || ',2,3,4,' || trunc(l_discount * 180)::INT || ',' || trunc(l_tax * 255)::INT || ',0,255)' AS stroke,
CASE WHEN l_discount < 0.04 THEN 'object' WHEN l_tax < 0.01 THEN 'background' WHEN l_linenumber % 2 = 0 AND l_tax < 0.06 THEN 'other' ELSE 'contour' END AS region FROM lineitem""")
def strokes(t):
    c = F.col
    one = F.array(F.array(c("l_tax"), c("l_discount")), F.array(F.lit(0.5), F.lit(1.0)))
    point = F.array(c("l_quantity"), *(F.lit(float(k)) for k in (2, 3, 4)), c("l_discount"), c("l_tax"), F.lit(0.0), F.lit(1.0))
    return t("lineitem").select("l_orderkey", "l_linenumber", X.stroke_text(one, F.lit("[coarse]")).alias("strokes"), X.point_stroke(point).alias("stroke"), X.sampled_region(c("l_discount") * 10, c("l_tax") * 10, c("l_linenumber") % 2 == 0).alias("region"))


def cues(t) -> DataFrame:
    """A cue of each event: its user is the video, its time of the month the start."""
    start = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000 - 1704067200).cast("double")
    return t("events").select(F.concat(F.lit("v"), "user_id").alias("video_id"), F.col("event_id").alias("pos"), start.alias("start_s"), (start + F.floor("value") * 60).alias("end_s"), F.concat("event_type", F.lit(" "), F.floor("value")).alias("text"))


_CUES = "WITH c AS (SELECT 'v' || user_id video_id, event_id pos, epoch(ts)::DOUBLE - 1704067200 start_s, epoch(ts)::DOUBLE - 1704067200 + floor(value) * 60 end_s, event_type || ' ' || floor(value)::BIGINT AS text FROM events)"
_CLOCK = "lpad((floor({0} / 3600)::BIGINT)::VARCHAR, greatest(2, length((floor({0} / 3600)::BIGINT)::VARCHAR))::INT, '0') || ':' || lpad((floor({0} / 60)::BIGINT % 60)::VARCHAR, 2, '0') || ':' || lpad((floor({0})::BIGINT % 60)::VARCHAR, 2, '0') || '.' || lpad((floor({0} * 1000 + 0.000001)::BIGINT % 1000)::VARCHAR, 3, '0')"


_CLIPS = _CUES + f""", t AS (SELECT video_id, max(end_s) total FROM c GROUP BY 1), s AS (SELECT video_id, i + 1 clip_no, i * 7200.0::DOUBLE a, least((i + 1) * 7200.0::DOUBLE, total) b FROM t, range(0, 10000) r(i) WHERE i < ceil(total / 7200.0)),
h AS (SELECT s.video_id, clip_no, pos, greatest(start_s, a) - a x, least(end_s, b) - a y, text FROM s JOIN c ON c.video_id = s.video_id AND end_s > a AND start_s < b), l AS (SELECT video_id, clip_no, string_agg(chr(10) || {_CLOCK.format('x')} || ' --> ' || {_CLOCK.format('y')} || chr(10) || text || chr(10), '' ORDER BY pos) k FROM h WHERE y > x GROUP BY ALL)
SELECT s.video_id, lpad(clip_no::VARCHAR, 4, '0') || '.vtt' AS file, 'WEBVTT' || chr(10) || coalesce(k, '') AS vtt FROM s LEFT JOIN l USING (video_id, clip_no)"""


@query(_CLIPS)
def clip_subtitles(t):
    return S.clip_files(cues(t), 7200.0)


@query(_CLIPS)
def clips_by_sql(t):
    """The same by the table function, called from SQL."""
    rows = cues(t)
    register(rows.sparkSession)
    return rows.sparkSession.sql("SELECT video_id, file, vtt FROM clips(TABLE({cues}) PARTITION BY (video_id), 7200.0D)", cues=rows)


@query("""WITH p AS (SELECT page_id, unnest(list_filter(list_transform(regexp_extract_all(html, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), lambda x: x <> '')) paragraph FROM pages)
SELECT page_id, count(*) n, md5(string_agg(md5(paragraph), ',' ORDER BY md5(paragraph))) digest FROM p GROUP BY 1""")
def paragraphs_by_sql(t):
    """Paragraphs by the table function, joined laterally."""
    pages = t("pages")
    register(pages.sparkSession)
    rows = pages.sparkSession.sql("SELECT page_id, p.pos, p.paragraph FROM {pages}, LATERAL html_rows(html) p", pages=pages)
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list(F.md5("paragraph"))), ",")).alias("digest"))


@query(_CUES + " SELECT video_id, min(pos) pos, text FROM c GROUP BY video_id, text")
def first_texts(t):
    return S.once_each(cues(t)).select("video_id", "pos", "text")


@query("WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS clip_no, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS caption, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END subtitle FROM documents) SELECT clip_no * 2 AS pos, 'caption__' || lpad(clip_no::VARCHAR, 5, '0') doc_key, caption AS text FROM d WHERE caption <> '' UNION ALL SELECT clip_no * 2 + 1, 'subtitle__' || lpad(clip_no::VARCHAR, 5, '0'), subtitle FROM d WHERE subtitle IS NOT NULL")
def memory_documents(t):
    from plotloom.operators.relate import in_order

    d = in_order(t("documents").select("doc_id", "lang", "source"), "doc_id", "at")
    clips = d.select((F.col("at") + 1).alias("clip_no"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("lang")).alias("caption"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("subtitle"))
    return S.clip_memory(clips)


@query("""WITH r AS (SELECT user_id query_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) rank, lpad((event_id % 9)::VARCHAR, 5, '0') clip, event_id % 4 AS kind FROM events), f AS (SELECT query_id, clip, min(rank) rank FROM r WHERE kind <> 3 GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) k FROM f), m AS (SELECT lpad((event_id % 9)::VARCHAR, 5, '0') clip, arg_max(CASE WHEN event_id % 4 IN (0, 1) THEN event_type END, CASE WHEN event_id % 4 IN (0, 1) THEN event_id END) c, arg_max(CASE WHEN event_id % 4 = 2 THEN event_type END, CASE WHEN event_id % 4 = 2 THEN event_id END) s FROM events WHERE event_id % 4 <> 3 GROUP BY 1)
SELECT query_id, string_agg(coalesce('Clip Summary: ' || c, '') || ',' || coalesce('Clip Subtitles: ' || s, '') || chr(10), '' ORDER BY rank) context FROM p JOIN m USING (clip) WHERE k <= 3 GROUP BY 1""")
def found_context(t):
    e = F.col("event_id")
    kind = F.when(e % 4 < 2, "caption__").when(e % 4 == 2, "subtitle__")
    key = F.when(e % 4 == 3, "summary").otherwise(F.concat(kind, F.lpad((e % 9).cast("string"), 5, "0")))
    rows = t("events").select(F.col("user_id").alias("query_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rank"), key.alias("doc_key"))
    return S.related_context(rows, t("events").select(e.alias("pos"), key.alias("doc_key"), F.col("event_type").alias("text")), 3)


# What is said between frames is a fold over frames; tests hold it against a plain loop.
@query(None)
def frame_captions(t):
    videos = t("events").groupBy("user_id").agg(F.count("*").alias("n")).select(F.concat(F.lit("v"), "user_id").alias("video_id"), (F.col("n") * 20).alias("frames"), F.lit(2.5).alias("fps"))
    said = cues(t).select("video_id", "pos", (F.col("pos") % 500).cast("double").alias("start_s"), (F.col("pos") % 500 + 30).cast("double").alias("end_s"), "text")
    return S.frame_captions(videos, said).unionByName(S.frame_captions(videos, said, words=True).withColumn("video_id", F.concat(F.lit("w"), "video_id")))


@query("SELECT event_id, quantile_disc(value, 0.5) OVER w AS middle, round(avg(value) OVER w, 9) AS mean, max(value) OVER w AS highest, value AS latest, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) so_far, round(sum(value * (event_id % 3)) OVER a / nullif(sum(event_id % 3) OVER a, 0), 9) weighted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def look_back_statistics(t):
    return R.look_back_rows(t("events").withColumn("n", F.col("event_id") % 3), ["user_id"], ["ts", "event_id"], "value", "n").select("event_id", "middle", F.round("mean", 9).alias("mean"), "highest", "latest", F.round("so_far", 9).alias("so_far"), F.round("weighted", 9).alias("weighted"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings), s AS (SELECT q.vec_id query_id, d.vec_id pos, CASE WHEN d.vec_id % 3 = 0 THEN 'summary' ELSE 'caption__' || d.vec_id END doc_key, list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e))) s FROM v q JOIN v d ON d.vec_id % 10 = q.vec_id % 10 AND d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos) k, count(*) OVER (PARTITION BY query_id) n FROM s), b AS (SELECT *, max(CASE WHEN k = 1 THEN doc_key END) OVER (PARTITION BY query_id) f FROM r)
SELECT 1 AS wanted, query_id, k::INT AS rank, doc_key FROM b WHERE k <= 1 OR (f = 'summary' AND k <= 2) UNION ALL SELECT 4, query_id, k::INT, doc_key FROM b WHERE k <= 4 UNION ALL SELECT -1, query_id, (row_number() OVER (PARTITION BY query_id ORDER BY pos))::INT, doc_key FROM b""")
def neighbours(t):
    e = t("embeddings").select("vec_id", F.col("embedding").alias("v"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v", (F.col("vec_id") % 10).alias("index"))
    docs = e.select((F.col("vec_id") % 10).alias("index"), F.col("vec_id").alias("pos"), F.when(F.col("vec_id") % 3 == 0, "summary").otherwise(F.concat(F.lit("caption__"), "vec_id")).alias("doc_key"), "v")
    out = None
    for k in (1, 4, -1):
        rows = R.neighbours(asked, docs, k, skip_own=True).select(F.lit(k).alias("wanted"), "query_id", "rank", "doc_key")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT lang, count(*) total, count(*) FILTER (doc_id % 3 = 0) skipped, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 7 <> 0) processed, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 7 = 0) failed FROM documents GROUP BY 1")
def run_counters(t):
    done = t("documents").where("doc_id % 3 = 0").select("doc_id")
    failed = t("documents").where("doc_id % 7 = 0").select("doc_id")
    return R.run_counters(t("documents").select("doc_id", "lang"), done, failed, ["doc_id"], ["lang"])


@query("SELECT doc_id, lang, source, epoch, (row_number() OVER (PARTITION BY epoch, lang ORDER BY md5(doc_id || '|' || epoch), doc_id))::INT AS place FROM documents, range(0, 2) r(epoch)")
def epoch_order(t):
    return R.shuffled(t("documents").select("doc_id", "lang", "source"), "doc_id", epochs=2, within=["lang"])


@query("""WITH n AS (SELECT source, row_number() OVER (ORDER BY source) - 1 k, count(*) n FROM documents GROUP BY 1), w AS (SELECT *, CASE WHEN k % 2 = 0 THEN 3.0 ELSE 1.0 END w FROM n), c AS (SELECT source, n, sum(w) OVER (ORDER BY source) / sum(w) OVER () up, (sum(w) OVER (ORDER BY source) - w) / sum(w) OVER () lo FROM w),
d AS (SELECT i, source, n FROM (SELECT i, ('0x' || md5(i || '|mix')[1:8])::BIGINT / 4294967296.0::DOUBLE u FROM range(0, 5000) r(i)) JOIN c ON u >= lo AND u < up), e AS (SELECT i, source, (row_number() OVER (PARTITION BY source ORDER BY i) - 1) % n AS seat FROM d),
o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|mix'), doc_id) - 1 AS seat FROM documents) SELECT i AS draw, doc_id, source FROM e JOIN o USING (source, seat)""")
def drawn_mixture(t):
    docs = t("documents").select("doc_id", "source")
    ratios = R.in_order(docs.select("source").distinct(), "source", "k").select("source", F.when(F.col("k") % 2 == 0, 3.0).otherwise(1.0).alias("ratio"))
    return R.drawn_mixture(docs, "source", "doc_id", ratios, 5000, "mix")


@query("""WITH c AS (SELECT o_custkey % 7 AS grp, o_orderpriority a, count(*) n FROM orders GROUP BY ALL), q AS (SELECT c_custkey, c_custkey % 8 AS grp FROM customer), w AS (SELECT q.c_custkey, c.a, coalesce(c.n, 0) n FROM q JOIN c USING (grp)),
u AS (SELECT *, sum(n) OVER (PARTITION BY c_custkey ORDER BY a)::DOUBLE / sum(n) OVER (PARTITION BY c_custkey) up, ('0x' || md5(c_custkey || '|0')[1:8])::BIGINT / 4294967296.0::DOUBLE d FROM w) SELECT c_custkey, min(a) answer FROM u WHERE up > d GROUP BY 1""")
def seeded_answers(t):
    counts = t("orders").groupBy((F.col("o_custkey") % 7).alias("grp"), F.col("o_orderpriority").alias("answer")).agg(F.count("*").alias("n"))
    asked = t("customer").select("c_custkey", (F.col("c_custkey") % 8).alias("grp")).join(counts, "grp")
    return R.pick_by_weight(asked, ["c_custkey"], "answer", "n", "0")
