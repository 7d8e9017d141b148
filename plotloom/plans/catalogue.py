"""The engine's registered queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plotloom.functions import numbers as N
from plotloom.functions import text as T
from plotloom.operators import metrics as M
from plotloom.operators import relate as R
from plotloom.operators.prefix import even_parts
from plotloom.plans.registry import query
from plotloom.sources.readers import result_key
from plotloom.streaming.windows import segments

_METRICS = """
, cells AS (SELECT {k} t, p, count(*) n FROM base GROUP BY ALL)
, sides AS (SELECT {k} t AS c, n AS support, 0 AS named, CASE WHEN t = p THEN n ELSE 0 END AS hit FROM cells UNION ALL SELECT {k} p, 0, n, 0 FROM cells)
, per AS (SELECT {k} c, sum(support)::DOUBLE s, sum(named)::DOUBLE m, sum(hit)::DOUBLE h FROM sides GROUP BY ALL)
, sc AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE h / m END pr, CASE WHEN s = 0 THEN 0 ELSE h / s END rc FROM per)
, f AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END f1 FROM sc)
SELECT {k} sum(s)::BIGINT total, sum(h)::BIGINT correct, round(sum(h) / sum(s), 6) accuracy, round(avg(pr), 6) precision_macro, round(sum(pr * s) / sum(s), 6) precision_weighted,
round(avg(rc), 6) recall_macro, round(sum(rc * s) / sum(s), 6) recall_weighted, round(avg(f1), 6) f1_macro, round(sum(f1 * s) / sum(s), 6) f1_weighted,
CASE WHEN sum(s * m) / (sum(s) * sum(s)) = 1 THEN NULL ELSE round((sum(h) / sum(s) - sum(s * m) / (sum(s) * sum(s))) / (1 - sum(s * m) / (sum(s) * sum(s))), 6) END kappa FROM f {g}
"""


@query("WITH base AS (SELECT quality::VARCHAR t, toxic::VARCHAR p FROM labels)" + _METRICS.format(k="", g=""))
def labels_metrics(t):
    return M.class_metrics(t("labels"), "quality", "toxic")


@query("WITH base AS (SELECT lang, source, quality::VARCHAR t, toxic::VARCHAR p FROM labels JOIN documents USING (doc_id))" + _METRICS.format(k="lang, source,", g="GROUP BY lang, source"))
def metrics_by_category(t):
    return M.class_metrics(t("labels").join(t("documents").select("doc_id", "lang", "source"), "doc_id"), "quality", "toxic", ["lang", "source"])


@query("WITH r AS (SELECT lang, doc_id % 3 AS run, avg((quality = toxic)::INT) acc FROM labels JOIN documents USING (doc_id) GROUP BY ALL) SELECT lang, round(avg(acc), 6) acc, round(stddev_pop(acc), 6) acc_std FROM r GROUP BY lang")
def run_mean_std(t):
    rows = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").groupBy("lang", (F.col("doc_id") % 3).alias("run")).agg(F.avg((F.col("quality") == F.col("toxic")).cast("int")).alias("acc"))
    return M.mean_and_deviation(rows, ["lang"], ["acc"])


@query("SELECT lang, round(avg(CASE WHEN doc_id % 3 = 0 THEN (quality = toxic)::INT END), 6) run0, round(avg(CASE WHEN doc_id % 3 = 1 THEN (quality = toxic)::INT END), 6) run1, round(avg(CASE WHEN doc_id % 3 = 2 THEN (quality = toxic)::INT END), 6) run2 FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def metrics_pivot(t):
    rows = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").withColumn("run", F.concat(F.lit("run"), F.col("doc_id") % 3))
    return rows.groupBy("lang").pivot("run", ["run0", "run1", "run2"]).agg(F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 6))


@query("SELECT lang, grouping(lang)::INT AS whole, count(*) n, round(avg(n_chars), 4) chars FROM documents GROUP BY GROUPING SETS ((), (lang))")
def grouping_levels(t):
    return t("documents").groupingSets([[], [F.col("lang")]], F.col("lang")).agg(F.grouping("lang").cast("int").alias("whole"), F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("chars"))


_LETTER = """CASE WHEN length(s) = 0 THEN NULL WHEN u[1:1] IN ('A','B','C','D') THEN u[1:1] ELSE coalesce(
upper(nullif(regexp_extract(s, '(?i)answer\\s+is\\s+([A-D])', 1), '')), upper(nullif(regexp_extract(s, '(?i)answer:\\s*([A-D])', 1), '')), upper(nullif(regexp_extract(s, '(?i)select\\s+([A-D])', 1), '')),
upper(nullif(regexp_extract(s, '(?i)option\\s+([A-D])', 1), '')), upper(nullif(regexp_extract(s, '(?i)choose\\s+([A-D])', 1), '')), upper(nullif(regexp_extract(s, '(?i)\\b([A-D])\\s*[.):]', 1), '')),
nullif(regexp_extract(u, '\\b([A-D])\\b', 1), ''), CASE WHEN (contains(u,'A')::INT + contains(u,'B')::INT + contains(u,'C')::INT + contains(u,'D')::INT) = 1 THEN CASE WHEN contains(u,'A') THEN 'A' WHEN contains(u,'B') THEN 'B' WHEN contains(u,'C') THEN 'C' ELSE 'D' END END) END"""


@query(f"SELECT p_partkey, {_LETTER} letter FROM (SELECT p_partkey, trim(p_name || ': ' || p_type) s, upper(trim(p_name || ': ' || p_type)) u FROM part)")
def answer_letter(t):
    return t("part").select("p_partkey", T.answer_letter(F.concat("p_name", F.lit(": "), "p_type")).alias("letter"))


@query("SELECT p_partkey, p_size % 5 = p_partkey % 4 OR (p_size % 5 < 4 AND (list_value(p_brand, p_type, p_brand, 'x'))[p_size % 5 + 1] = (list_value(p_brand, p_type, p_brand, 'x'))[p_partkey % 4 + 1]) AS correct FROM part")
def answer_correct(t):
    options = F.array("p_brand", "p_type", "p_brand", F.lit("x"))
    return t("part").select("p_partkey", T.is_correct(T.index_letter((F.col("p_size") % 5).cast("int")), T.index_letter((F.col("p_partkey") % 4).cast("int")), options).alias("correct"))


@query("SELECT item_id, NOT (contains(lower(text), 'all') OR contains(lower(text), 'unknown')) AS kept, NOT regexp_matches(lower(text), '\\ball\\b') AND NOT contains(lower(text), 'unknown') AS valid FROM benchmark")
def question_filter(t):
    return t("benchmark").select("item_id", T.question_kept(F.col("text"), F.array(F.lit("one"), F.lit("two")), F.lit(0)).alias("kept"), T.valid_text(F.col("text")).alias("valid"))


@query("SELECT CASE event_type WHEN 'click' THEN 'Temporal: Click' WHEN 'view' THEN 'Temporal: View' ELSE event_type END AS kind, count(*) n, count(*) FILTER (value > 50) large FROM events GROUP BY 1")
def question_type_rename(t):
    kind = F.when(F.col("event_type") == "click", "Temporal: Click").when(F.col("event_type") == "view", "Temporal: View").otherwise(F.col("event_type"))
    return t("events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("large"))


@query("""WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) title, regexp_extract_all(html, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1) b FROM pages),
c AS (SELECT page_id, title, list_filter(list_transform(b, lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), lambda x: x <> '') b FROM p)
SELECT page_id, title, len(b)::INT paragraphs, array_to_string(b, chr(10)) body FROM c""")
def html_paragraphs(t):
    body = T.paragraphs(F.col("html"))
    return t("pages").select("page_id", T.title(F.col("html")).alias("title"), F.size(body).alias("paragraphs"), F.array_join(body, "\n").alias("body"))


@query("SELECT conv_id, turn, upper(trim(regexp_replace(role, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) speaker FROM conversations WHERE role ~ '^[A-Za-z]' AND trim(text) <> ''")
def dialogue_split(t):
    pairs = T.dialogue_pairs(F.concat(F.col("role"), F.lit(": "), F.translate("text", ":", ";")))
    return t("conversations").select("conv_id", "turn", F.explode(pairs).alias("p")).select("conv_id", "turn", "p.speaker")


@query("SELECT c_custkey FROM customer WHERE NOT (contains(upper(c_name || c_mktsegment), 'ALL') OR contains(upper(c_name || c_mktsegment), 'BOTH') OR contains(upper(c_name || c_mktsegment), 'GUYS') OR contains(upper(c_name || c_mktsegment), 'GIRLS') OR contains(c_mktsegment, '(') OR contains(c_mktsegment, ')') OR contains(upper(c_name || c_mktsegment), ' AND ') OR contains(upper(c_name || c_mktsegment), ' TO ') OR contains(upper(c_name || c_mktsegment), 'ITNERCOM'))")
def bad_subject_filter(t):
    return t("customer").where(~T.bad_speaker(F.upper(F.concat("c_name", "c_mktsegment")))).select("c_custkey")


@query("SELECT n_nationkey, trim(regexp_extract('[Scene: ' || n_name || ', everyone]', '(?i)\\[Scene\\s*[:\\-]?\\s*([^\\],]+)', 1)) place FROM nation")
def location_extract(t):
    return t("nation").select("n_nationkey", T.location(F.concat(F.lit("[Scene: "), "n_name", F.lit(", everyone]"))).alias("place"))


@query("WITH s AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) scene FROM conversations) SELECT conv_id, scene::BIGINT scene, count(*) turns, sum(length(text))::BIGINT chars FROM s WHERE role <> 'user' GROUP BY ALL")
def scene_sessionise(t):
    scene = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return t("conversations").withColumn("scene", scene).where("role <> 'user'").groupBy("conv_id", "scene").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@query("SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN conv_id || '_scene_' || lpad((sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) - 1)::VARCHAR, 3, '0') ELSE '' END AS label FROM conversations")
def context_label(t):
    clip = F.col("role") == "assistant"
    no = F.sum(clip.cast("int")).over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t("conversations").select("conv_id", "turn", F.when(clip, F.concat("conv_id", F.lit("_scene_"), F.lpad(no.cast("string"), 3, "0"))).otherwise("").alias("label"))


@query("SELECT event_id, strftime(ts, '%m%d') || '_event_' || lpad((row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id))::VARCHAR, 5, '0') AS label FROM events")
def event_number(t):
    no = F.row_number().over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id"))
    return t("events").select("event_id", F.concat(F.date_format("ts", "MMdd"), F.lit("_event_"), F.lpad(no.cast("string"), 5, "0")).alias("label"))


@query("WITH f AS (SELECT conv_id, role, min(turn) t FROM conversations GROUP BY ALL) SELECT conv_id, string_agg(role, ',' ORDER BY t) seen, string_agg(role, ',' ORDER BY role) sorted FROM f GROUP BY conv_id")
def distinct_speakers(t):
    first = t("conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("t", "role"))).alias("x"))
    names = F.transform("x", lambda v: v["role"])
    return first.select("conv_id", F.array_join(names, ",").alias("seen"), F.array_join(F.array_sort(names), ",").alias("sorted"))


@query("WITH s AS (SELECT p_partkey, list_filter([p_brand, 'Brand#11 '], lambda x: list_contains(['Brand#12', 'Brand#13', 'SMALL', 'steel'], trim(x))) listed, list_filter(['Brand#12', 'Brand#13', 'SMALL', 'steel'], lambda x: contains(lower(p_name || ' ' || p_type), lower(x))) held FROM part) SELECT p_partkey, array_to_string(CASE WHEN len(listed) > 0 THEN listed ELSE held END, '|') subjects FROM s")
def subject_fallback(t):
    scene = F.array(*map(F.lit, ("Brand#12", "Brand#13", "SMALL", "steel")))
    kept = T.subjects_kept(F.array("p_brand", F.lit("Brand#11 ")), scene, F.concat("p_name", F.lit(" "), "p_type"))
    return t("part").select("p_partkey", F.array_join(kept, "|").alias("subjects"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) k FROM events")
def json_events(t):
    return t("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT 'type' AS kind, event_type AS name, count(*) n FROM events GROUP BY 2 UNION ALL SELECT 'day', ts::DATE::VARCHAR, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'user', user_id::VARCHAR, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'letter', chr((65 + event_id % 4)::INT), count(*) FROM events GROUP BY 2")
def question_stats(t):
    cells = F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("string").alias("name")) for k, c in (("type", F.col("event_type")), ("day", F.to_date("ts")), ("user", F.col("user_id")), ("letter", T.index_letter((F.col("event_id") % 4).cast("int"))))))
    return t("events").select(F.explode(cells).alias("c")).groupBy("c.kind", "c.name").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, 'A. ' || trim(ltrim(ltrim(trim(p_name), 'ABCD1234'), '. ')) || chr(10) || 'B. ' || trim(ltrim(ltrim(trim(p_brand), 'ABCD1234'), '. ')) plain, CASE WHEN p_name[1:2] IN ('A.','B.','C.','D.') THEN p_name ELSE 'A. ' || p_name END || chr(10) || CASE WHEN p_brand[1:2] IN ('A.','B.','C.','D.') THEN p_brand ELSE 'B. ' || p_brand END kept FROM part")
def option_relabel(t):
    options = F.array("p_name", "p_brand")
    return t("part").select("p_partkey", F.array_join(T.relabel_plain(options), "\n").alias("plain"), T.relabel_kept(options).alias("kept"))


@query("WITH e AS (SELECT event_id, event_type, ts::DATE d FROM events), p AS (SELECT a.event_id, b.event_id o, row_number() OVER (PARTITION BY a.event_id ORDER BY b.event_id) rn FROM e a JOIN e b ON a.d = b.d AND a.event_type = b.event_type AND a.event_id <> b.event_id) SELECT event_id, string_agg(o::VARCHAR, ',' ORDER BY o) others FROM p WHERE rn <= 3 GROUP BY event_id")
def same_location_others(t):
    rows = R.first_others(t("events").select("event_id", "event_type", F.to_date("ts").alias("d")), ["d", "event_type"], "event_id")
    return rows.where(F.size("others") > 0).select("event_id", F.array_join("others", ",").alias("others"))


_RING = "(('0x' || md5(event_id::VARCHAR)[1:8])::BIGINT + k) % n"


@query(f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY md5(x) || '|' || x) - 1 seat, count(*) OVER (PARTITION BY d) n FROM (SELECT DISTINCT ts::DATE d, event_type x FROM events)) SELECT event_id, arg_min(x, k) wrong FROM events e, p, range(0, 2) r(k) WHERE p.d = e.ts::DATE AND p.seat = {_RING} AND k < n AND x <> e.event_type GROUP BY 1")
def wrong_location(t):
    rows = R.ring_draws(t("events").select("event_id", "event_type", F.to_date("ts").alias("d")), "event_id", ["d"], "event_type", 1)
    return rows.where(F.size("others") > 0).select("event_id", F.get("others", 0).alias("wrong"))


@query(f"WITH p AS (SELECT *, row_number() OVER (ORDER BY md5(x) || '|' || x) - 1 seat, count(*) OVER () n FROM (SELECT DISTINCT event_type x FROM events)), l AS (SELECT event_id, any_value(event_type) c, list(x ORDER BY k)[1:3] o FROM events e, p, range(0, 4) r(k) WHERE p.seat = {_RING} AND k < n AND x <> e.event_type GROUP BY 1) SELECT event_id, (event_id % 4)::INT slot, array_to_string(list_concat(list_concat(o[1:event_id % 4], [c]), o[event_id % 4 + 1:]), '|') options FROM l")
def location_distractors(t):
    rows = R.ring_draws(t("events").select("event_id", "event_type"), "event_id", [], "event_type", 3)
    slot = (F.col("event_id") % 4).cast("int")
    options = F.concat(F.slice("others", F.lit(1), slot), F.array("event_type"), F.slice("others", slot + 1, F.lit(3)))
    return rows.select("event_id", slot.alias("slot"), F.array_join(options, "|").alias("options"))


@query("WITH d AS (SELECT ts::DATE d, count(*) n, min(event_id) lo, max(event_id) hi FROM events GROUP BY 1), w AS (SELECT d, count(*) OVER f k, sum(n) OVER f n, min(lo) OVER f lo, max(hi) OVER f hi FROM d WINDOW f AS (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT d::VARCHAR AS day, n::BIGINT n, lo, hi, CASE WHEN n > 3 THEN least(greatest(1, n::BIGINT // 3), n::BIGINT // 2) ELSE 0 END::BIGINT AS i FROM w WHERE k = 3")
def span_frame(t):
    days = t("events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    line = R.in_order(days, "d", "at")
    spans = line.select("d", F.explode(F.sequence(F.col("at") - 2, F.col("at"))).alias("at")).join(line.select("at", "n", "lo", "hi"), "at")
    rows = spans.groupBy("d").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("k = 3")
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    return rows.select(F.col("d").cast("string").alias("day"), "n", "lo", "hi", F.when(F.col("n") > 3, F.least(third, F.floor(F.col("n") / 2))).otherwise(0).alias("i"))


@query("WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) rn FROM events) SELECT event_type, max(CASE WHEN rn = 1 THEN event_id END) latest, string_agg(CASE WHEN rn > 1 THEN event_id::VARCHAR END, ',' ORDER BY rn DESC) before FROM r WHERE rn <= 4 GROUP BY 1")
def latest_event(t):
    rn = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = t("events").withColumn("rn", rn).where("rn <= 4").groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("k"), "event_id"))).alias("x"))
    return rows.select("event_type", F.element_at("x", -1)["event_id"].alias("latest"), F.array_join(F.transform(F.slice("x", 1, F.size("x") - 1), lambda s: s["event_id"]), ",").alias("before"))


@query("SELECT user_id, count(*) n, count(DISTINCT ts::DATE) AS days, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) ids FROM events GROUP BY 1 HAVING count(DISTINCT ts::DATE) > 1 AND count(*) >= 4")
def single_cue_sequence(t):
    rows = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"), F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("x")).where("days > 1 AND n >= 4")
    return rows.select("user_id", "n", "days", F.array_join(F.transform("x", lambda s: s["event_id"]), ",").alias("ids"))


@query("SELECT doc_id, i::INT AS clip, lpad(i::VARCHAR, 5, '0') || '.mp4' file, (least((i + 1) * 800, n_chars) - i * 800)::BIGINT size FROM (SELECT doc_id, n_chars, unnest(range(0, ((n_chars + 799) // 800)::BIGINT)) i FROM documents)")
def clip_segments(t):
    n = F.ceil(F.col("n_chars") / 800)
    cut = t("documents").where("n_chars > 0").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return cut.select("doc_id", F.col("i").cast("int").alias("clip"), F.concat(F.lpad(F.col("i").cast("string"), 5, "0"), F.lit(".mp4")).alias("file"), (F.least((F.col("i") + 1) * 800, "n_chars") - F.col("i") * 800).alias("size"))


@query("WITH c AS (SELECT event_id, user_id, epoch(ts)::DOUBLE a, epoch(ts) + value * 60 b FROM events), s AS (SELECT event_id AS span_id, user_id, epoch(ts)::DOUBLE a, epoch(ts)::DOUBLE + 7200 b FROM events WHERE event_type = 'purchase') SELECT span_id, event_id, round(greatest(s.a, c.a) - s.a, 3) start, round(least(s.b, c.b) - s.a, 3) stop FROM s JOIN c USING (user_id) WHERE c.a < s.b AND c.b > s.a")
def interval_join(t):
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("double")
    e = t("events").withColumn("a", at)
    cues = e.select("user_id", "event_id", F.col("a").alias("c_start"), (F.col("a") + F.col("value") * 60).alias("c_end"))
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), F.col("a").alias("s_start"), (F.col("a") + 7200).alias("s_end"))
    hit = R.interval_join(spans, cues, 7200.0, ["user_id"])
    return hit.select("span_id", "event_id", F.round(F.greatest("s_start", "c_start") - F.col("s_start"), 3).alias("start"), F.round(F.least("s_end", "c_end") - F.col("s_start"), 3).alias("stop"))


@query("WITH p AS (SELECT event_id, user_id, epoch(ts)::DOUBLE a FROM events WHERE event_type <> 'purchase'), c AS (SELECT event_id AS cue_id, user_id, epoch(ts)::DOUBLE a, epoch(ts)::DOUBLE + 86400 b FROM events WHERE event_type = 'purchase') SELECT p.event_id, arg_min(cue_id, (c.a, cue_id)) cue_id FROM p JOIN c USING (user_id) WHERE c.a < p.a + 0.0005 AND c.b > p.a GROUP BY 1")
def first_cue(t):
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("double")
    e = t("events").withColumn("a", at)
    cues = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("cue_id"), F.col("a").alias("c_start"), (F.col("a") + 86400).alias("c_end"))
    points = e.where("event_type <> 'purchase'").select("user_id", "event_id", F.col("a").alias("s_start"), (F.col("a") + 0.0005).alias("s_end"))
    return R.interval_join(points, cues, 86400.0, ["user_id"]).groupBy("event_id").agg(F.min_by("cue_id", F.struct("c_start", "cue_id")).alias("cue_id"))


@query("SELECT time_bucket(INTERVAL '80 seconds', ts, TIMESTAMP '1970-01-01') AS start, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1")
def tumbling_segments(t):
    return segments(t("events"))


@query("SELECT lang, part::INT part, sum(n_chars)::BIGINT chars FROM (SELECT lang, n_chars, ntile(7) OVER (PARTITION BY lang ORDER BY doc_id) part FROM documents) GROUP BY ALL")
def ntile_paragraphs(t):
    return even_parts(t("documents").select("lang", "doc_id", "n_chars"), 7, ["doc_id"], by=["lang"]).groupBy("lang", "part").agg(F.sum("n_chars").alias("chars"))


@query("SELECT event_id, quantile_disc(value, 0.5) OVER w median, round(sum(value) OVER w, 2) recent, max(value) OVER w highest, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def sliding_twenty(t):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    w = order.rowsBetween(-19, 0)
    held = F.array_sort(F.collect_list("value").over(w))
    return t("events").select("event_id", F.get(held, ((F.size(held) - 1) / 2).cast("int")).alias("median"), F.round(F.sum("value").over(w), 2).alias("recent"), F.max("value").over(w).alias("highest"), F.round(F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("so_far"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(w) OVER (PARTITION BY conv_id ORDER BY turn) - w AS before FROM (SELECT conv_id, turn, len(string_split(text, ' ')) w FROM conversations)) WHERE before < 60")
def word_budget(t):
    w = F.size(F.split("text", " "))
    before = F.sum("w").over(Window.partitionBy("conv_id").orderBy("turn")) - F.col("w")
    return t("conversations").withColumn("w", w).withColumn("before", before).where("before < 60").select("conv_id", "turn")


@query("SELECT doc_id, array_to_string(list_transform(range(8), lambda i: (i * (n_chars - 1)) // 7), ',') spread, array_to_string(list_transform(range(8), lambda i: (i * n_chars) // 8), ',') starts FROM documents")
def sample_indices(t):
    return t("documents").select("doc_id", F.array_join(N.linspace(F.col("n_chars"), 8), ",").alias("spread"), F.array_join(N.arange(F.col("n_chars"), 8), ",").alias("starts"))


@query("SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 8)::INT AS batch FROM orders")
def minibatch_number(t):
    return t("orders").select("o_orderkey", F.floor((F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) / 8).cast("int").alias("batch"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) o_orderkey FROM orders GROUP BY 1")
def keep_first(t):
    return R.keep_first(t("orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


_COS = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) e FROM v), s AS (SELECT q.vec_id query_id, q.label ql, d.vec_id doc_id, d.label, list_dot_product(q.e, d.e) score FROM u q JOIN u d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"


def _vectors(t):
    e = t("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return e.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "v"), e


@query(_COS + " SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) score FROM r WHERE rank <= 5")
def cosine_topk(t):
    return R.top_cosine(*_vectors(t), 5).withColumn("score", F.round("score", 6)).select("query_id", "rank", "doc_id", "score")


@query(_COS + " SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) score FROM r WHERE rank <= 5")
def pruned_topk(t):
    """The same rows, of blocks that can hold them only."""
    return R.pruned_cosine(*_vectors(t), 5)[0].withColumn("score", F.round("score", 6)).select("query_id", "rank", "doc_id", "score")


@query(_COS + ", f AS (SELECT query_id, label, min(rank) k FROM r WHERE rank <= 10 GROUP BY ALL) SELECT query_id, string_agg(label::VARCHAR, ',' ORDER BY k) clips FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) n FROM f) WHERE n <= 3 GROUP BY 1")
def clips_from_keys(t):
    near = R.top_cosine(*_vectors(t), 10).join(t("embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    first = near.groupBy("query_id", "label").agg(F.min("rank").alias("k")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("k", "label"))).alias("x"))
    return first.select("query_id", F.array_join(F.transform(F.slice("x", 1, 3), lambda s: s["label"]), ",").alias("clips"))


@query(_COS + ", base AS (SELECT ql::VARCHAR t, label::VARCHAR p FROM r WHERE rank = 1)" + _METRICS.format(k="", g=""))
def knn_metrics(t):
    label = t("embeddings").select("vec_id", "label")
    near = R.top_cosine(*_vectors(t), 1).join(label.withColumnRenamed("label", "p"), F.col("doc_id") == F.col("vec_id")).drop("vec_id")
    return M.class_metrics(near.join(label.withColumnRenamed("label", "t"), F.col("query_id") == F.col("vec_id")), "t", "p")


@query("SELECT doc_id, array_to_string(string_split(trim(rtrim(regexp_replace(regexp_replace(lower(text), '[.!\"()*#:;~]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]{2,}', ' ', 'g'), chr(10))), ' ')[1:50], ' ') caption, trim(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9 \\t\\n\\x0B\\f\\r'']', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) alnum FROM documents")
def text_clean(t):
    return t("documents").select("doc_id", T.caption_clean(F.col("text")).alias("caption"), T.alnum_clean(F.col("text")).alias("alnum"))


def _marks_sql(column: str) -> str:
    out = column
    for m in T.MARKS:
        q = "'" + m + "'"
        out = f"replace({out}, {q}, CASE WHEN contains({column}, {q} || ' ') OR contains({column}, ' ' || {q}) OR regexp_matches({column}, '[0-9],[0-9]') THEN '' ELSE ' ' END)"
    return out


# a full stop before a digit is marked first, as the other engine's patterns can't look ahead
@query(f"SELECT doc_id, replace(array_to_string(l[1:33], '') || CASE WHEN len(l) > 33 THEN '.' || array_to_string(l[34:], '.') ELSE '' END, chr(1), '.') plain FROM (SELECT doc_id, string_split(regexp_replace({_marks_sql('text')}, '\\.([0-9])', chr(1) || '\\1', 'g'), '.') l FROM documents)")
def punctuation_norm(t):
    return t("documents").select("doc_id", T.punctuation(F.col("text")).alias("plain"))


def _case(table: dict[str, str]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return "CASE w " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items()) + " ELSE w END"


@query(f"SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(trim(regexp_replace(lower(text || ' one the two dont'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' '), lambda w: {_case(T.NUMBER_WORDS)}), lambda w: w NOT IN ('a','an','the')), lambda w: {_case(T.CONTRACTIONS)}), ' ') words FROM documents")
def digit_article_norm(t):
    return t("documents").select("doc_id", T.digits_articles(F.concat("text", F.lit(" one the two dont"))).alias("words"))


@query("SELECT event_id, strftime(ts, '%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') AS clock, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT AS seconds, (user_id * 3600 + 63)::INT AS iso FROM events")
def time_round_trip(t):
    clock = N.from_seconds((F.unix_micros(F.col("ts").cast("timestamp")) % 86400000000) / 1000000)
    iso = F.concat(F.lit("PT"), "user_id", F.lit("H1M3S"))
    return t("events").select("event_id", clock.alias("clock"), N.to_seconds(F.date_format("ts", "HH:mm:ss")).alias("seconds"), N.iso_seconds(iso).cast("int").alias("iso"))


@query("SELECT l_orderkey, l_linenumber, trunc(l_discount * 100)::INT x1, trunc(l_tax * 100)::INT y1, trunc(l_discount * 100)::INT + trunc(l_quantity / 50 * 100)::INT x2, round((greatest(least(10 + l_linenumber, 14) - greatest(5, l_linenumber) + 1, 0) * 10)::DOUBLE / (11 * 10 + 10 * 10 - greatest(least(10 + l_linenumber, 14) - greatest(5, l_linenumber) + 1, 0) * 10), 6) iou FROM lineitem")
def boxes(t):
    x1, y1, x2, _ = N.grid_box(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.lit(0.0))
    n = F.col("l_linenumber")
    lit = F.lit
    iou = N.iou((n, lit(0), n + 10, lit(9)), (lit(5), lit(0), lit(14), lit(9)))
    return t("lineitem").select("l_orderkey", "l_linenumber", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), F.round(iou, 6).alias("iou"))


@query("WITH g AS (SELECT o_custkey, mode_ AS guess FROM (SELECT o_custkey, min(o_orderpriority) mode_ FROM orders GROUP BY 1)), a AS (SELECT o_custkey, (o_orderpriority = guess)::INT e FROM orders JOIN g USING (o_custkey)), s AS (SELECT o_custkey, least(1.0, (sum(e) OVER (PARTITION BY o_custkey) - e) / 3.0) s FROM a) SELECT o_custkey, round(avg(s)::DOUBLE, 6) score FROM s GROUP BY 1")
def vqa_consensus(t):
    o = t("orders").select("o_custkey", "o_orderpriority")
    guess = o.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("guess"))
    return M.consensus(o.join(guess, "o_custkey"), "o_custkey", "o_orderpriority", "guess")


@query("SELECT o_custkey, round(least(1.0, count(*) FILTER (o_orderpriority = '1-URGENT') / 3.0)::DOUBLE, 6) direct, round(100 * avg((o_orderstatus = 'O')::INT), 4) exact FROM orders GROUP BY 1")
def answer_accuracies(t):
    return t("orders").groupBy("o_custkey").agg(F.round(F.least(F.lit(1.0), F.count_if(F.col("o_orderpriority") == "1-URGENT") / 3), 6).alias("direct"), F.round(100 * F.avg((F.col("o_orderstatus") == "O").cast("int")), 4).alias("exact"))


@query("SELECT round(avg(try_cast(s AS DOUBLE)), 6) score, round(100.0 * count(*) FILTER (contains(lower(p), 'yes')) / nullif(count(*) FILTER (contains(lower(p), 'yes')) + count(*) FILTER (contains(lower(p), 'no')), 0), 6) yes_rate FROM (SELECT CASE WHEN quality = 1 THEN (doc_id % 6)::VARCHAR ELSE 'bad' END s, CASE WHEN toxic = 1 THEN 'No' ELSE 'Yes' END p FROM labels)")
def judge_mean(t):
    rows = t("labels").select(F.when(F.col("quality") == 1, (F.col("doc_id") % 6).cast("string")).otherwise("bad").alias("s"), F.when(F.col("toxic") == 1, "No").otherwise("Yes").alias("p"))
    yes, no = (F.count_if(F.lower("p").contains(w)) for w in ("yes", "no"))
    return rows.agg(F.round(F.avg(F.col("s").try_cast("double")), 6).alias("score"), F.round(F.try_divide(100 * yes, yes + no), 6).alias("yes_rate"))


@query("""WITH t AS (SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN text END, ' ' ORDER BY turn) g, string_agg(CASE WHEN role = 'user' THEN text END, ' ' ORDER BY turn) r FROM conversations GROUP BY 1), p AS (SELECT conv_id, string_split(g, ' ') g, string_split(r, ' ') r FROM t WHERE len(string_split(g, ' ')) >= 2 AND len(string_split(r, ' ')) >= 2),
a AS (SELECT conv_id, w, count(*) n FROM (SELECT conv_id, unnest(list_transform(range(1, len(g)), lambda i: g[i] || ' ' || g[i + 1])) w FROM p) GROUP BY ALL), b AS (SELECT conv_id, w, count(*) n FROM (SELECT conv_id, unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])) w FROM p) GROUP BY ALL)
SELECT conv_id, sum(least(a.n, coalesce(b.n, 0)))::BIGINT hits, sum(a.n)::BIGINT total FROM a LEFT JOIN b USING (conv_id, w) GROUP BY 1""")
def bigram_precision(t):
    said = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), " ")
    pairs = t("conversations").groupBy("conv_id").agg(said("assistant").alias("g"), said("user").alias("r"))
    return M.ngram_precision(pairs, "conv_id", F.col("g"), F.col("r"), 2)


@query("WITH c AS (SELECT o_custkey, o_orderpriority, count(*) n FROM orders GROUP BY ALL) SELECT o_custkey, arg_max(o_orderpriority, (n, -(o_orderpriority[1:1])::INT)) AS answer FROM c GROUP BY 1")
def mode_answer(t):
    counts = t("orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return counts.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("n", -F.substring("o_orderpriority", 1, 1).cast("int"))).alias("answer"))


@query("SELECT DISTINCT v AS word FROM (SELECT p_brand v FROM part GROUP BY 1 HAVING count(*) >= 3 UNION ALL SELECT p_type FROM part GROUP BY 1 HAVING count(DISTINCT p_size) >= 3 UNION ALL SELECT p_name FROM part)")
def vocabulary(t):
    part = t("part")
    brands = part.groupBy(F.col("p_brand").alias("word")).agg(F.count("*").alias("n")).where("n >= 3").select("word")
    types = part.groupBy(F.col("p_type").alias("word")).agg(F.countDistinct("p_size").alias("n")).where("n >= 3").select("word")
    return brands.unionByName(types).unionByName(part.select(F.col("p_name").alias("word"))).distinct()


@query("SELECT o_custkey, o_orderpriority, round(n::DOUBLE / sum(n) OVER (PARTITION BY o_custkey), 6) weight FROM (SELECT o_custkey, o_orderpriority, count(*) n FROM orders GROUP BY ALL)")
def answer_weights(t):
    n = F.count("*")
    return t("orders").groupBy("o_custkey", "o_orderpriority").agg(n.alias("n")).select("o_custkey", "o_orderpriority", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("o_custkey")), 6).alias("weight"))


@query("WITH c AS (SELECT o_custkey, o_orderpriority, count(*) n FROM orders GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)::DOUBLE / sum(n) OVER (PARTITION BY o_custkey) up, ('0x' || md5(o_custkey || '|7')[1:8])::BIGINT / 4294967296.0::DOUBLE draw FROM c) SELECT o_custkey, min(o_orderpriority) o_orderpriority FROM u WHERE up > draw GROUP BY 1")
def weighted_answer(t):
    return R.weighted_pick(t("orders"), ["o_custkey"], "o_orderpriority", "7")


@query("WITH f AS (SELECT user_id, min(event_id) first, max(event_id) last FROM events GROUP BY 1) SELECT user_id, (row_number() OVER (ORDER BY first) - 1)::INT dense, last FROM f")
def first_seen_id(t):
    seen = t("events").groupBy("user_id").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    return R.in_order(seen, "first", "dense").select("user_id", F.col("dense").cast("int").alias("dense"), "last")


@query("SELECT c_custkey, coalesce(sum(o_totalprice), 0.0)::DECIMAL(18,2)::DOUBLE total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_join_zero(t):
    spent = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    return t("customer").select("c_custkey").join(spent, "c_custkey", "left").select("c_custkey", F.coalesce("total", F.lit(0.0)).cast("decimal(18,2)").cast("double").alias("total"))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) missing, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) spare")
def full_key_check(t):
    lines, orders = t("lineitem").select(F.col("l_orderkey").alias("k")).distinct(), t("orders").select(F.col("o_orderkey").alias("k"))
    both = lines.withColumn("a", F.lit(1)).join(orders.withColumn("b", F.lit(1)), "k", "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("spare"))


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) o_orderstatus FROM orders GROUP BY 1")
def inner_last_wins(t):
    return R.last_by(t("orders"), ["o_custkey"], "o_orderstatus", "o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_events(t):
    return t("documents").select("doc_id").join(t("labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").distinct()


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_bag(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).unionByName(t("supplier").select(F.col("s_nationkey").alias("k")))


@query("(SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'left' FROM customer EXCEPT ALL SELECT s_nationkey, 'left' FROM supplier)")
def intersect_and_except(t):
    c, s = t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.exceptAll(s).withColumn("side", F.lit("left")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_suppkey FROM supplier")
def union_distinct(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).unionByName(t("supplier").select(F.col("s_suppkey").alias("k"))).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def difference(t):
    urgent = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(urgent)


@query("SELECT p_partkey, array_to_string(CASE WHEN lower(trim(p_brand)) = lower(trim(p_type)) THEN [p_brand] ELSE [p_brand, p_type] END, '|') AS options FROM part")
def option_dedupe(t):
    return t("part").select("p_partkey", F.array_join(T.ordered_distinct(F.array("p_brand", "p_type", F.upper("p_brand"), F.lit("all"), F.lit("Unknown x"))), "|").alias("options"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '3'), doc_id) rn FROM documents) WHERE rn <= 20")
def hash_sample(t):
    return R.hash_sample(t("documents"), "doc_id", 20, "3", ["lang"]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE ('0x' || md5(doc_id || '9')[1:8])::BIGINT / 4294967296.0::DOUBLE < CASE lang WHEN 'en' THEN 0.25 WHEN 'fr' THEN 0.5 ELSE 1.0 END")
def source_mixture(t):
    draw = F.conv(F.substring(F.md5(F.concat("doc_id", F.lit("9"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return t("documents").where(draw < F.when(F.col("lang") == "en", 0.25).when(F.col("lang") == "fr", 0.5).otherwise(1.0)).select("doc_id")


@query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Human: ' ELSE 'Other: ' END || text, '!@#' ORDER BY turn) AS folded FROM conversations GROUP BY 1")
def fold_conversation(t):
    line = F.concat(F.when(F.col("role") == "user", "Human: ").otherwise("Other: "), "text")
    held = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return held.select("conv_id", F.array_join(F.transform("x", lambda s: s["line"]), "!@#").alias("folded"))


@query("SELECT doc_id, source AS model, 'run_' || doc_id % 3 AS run, CASE WHEN lang = 'en' THEN 'with_context' ELSE 'without_context' END AS context, CASE WHEN lang = 'en' THEN 'vanilla' ELSE 'nn_3' END AS nn FROM documents")
def result_paths(t):
    plain = F.concat(F.lit("/x/results_plain/"), "source", F.lit("/with_context/run_"), F.col("doc_id") % 3, F.lit("/a.json"))
    ranked = F.concat(F.lit("/x/results_ranked/"), "source", F.lit("/run_"), F.col("doc_id") % 3, F.lit("/generic_caption/nn_3/a.json"))
    return t("documents").select("doc_id", F.when(F.col("lang") == "en", plain).otherwise(ranked).alias("path")).select("doc_id", *result_key(F.col("path")))


@query("WITH g AS (SELECT p_partkey, p_size, i, j FROM part, range(1, 7) a(i), range(1, 7) b(j) WHERE i * j BETWEEN 1 AND 6), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY abs((p_size + 3.0) / 20 - i::DOUBLE / j), i * j, i) k FROM g) SELECT p_partkey, i::INT i, j::INT j FROM r WHERE k = 1")
def aspect_ratio(t):
    grid = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(1, 7) for j in range(1, 7) if i * j <= 6))
    best = F.array_min(F.transform(grid, lambda g: F.struct(F.abs((F.col("p_size") + 3.0) / 20 - g["i"].cast("double") / g["j"]).alias("d"), (g["i"] * g["j"]).alias("n"), g["i"].alias("i"), g["j"].alias("j"))))
    return t("part").select("p_partkey", best["i"].alias("i"), best["j"].alias("j"))


@query("SELECT event_id, try_cast(replace(json_extract_string(props, '$.k'), '1', 'x') AS INT) AS k, try_cast(replace(json_extract_string(props, '$.k'), '1', 'x') AS INT) IS NULL AS failed FROM events")
def batch_errors(t):
    k = F.replace(F.get_json_object("props", "$.k"), F.lit("1"), F.lit("x")).try_cast("int")
    return t("events").select("event_id", k.alias("k"), k.isNull().alias("failed"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DECIMAL(18,2)::DOUBLE qty, round(avg(l_discount), 6) disc, count(*) n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def line_summary(t):
    return t("lineitem").where("l_shipdate <= DATE '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("decimal(18,2)").cast("double").alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count("*").alias("n"))
