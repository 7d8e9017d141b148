"""Queries of stories: scenes, events from free text, and the question families, over the events and conversations tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotloom.functions import story as Y
from plotloom.operators import stories as S
from plotloom.plans.registry import query


def story_events(t) -> DataFrame:
    """Events of daily episodes: (episode, event_id, description, location, subjects, clip, started)."""
    e, u = F.col("event_id"), F.col("user_id")
    scene = F.concat_ws("_", F.date_format("ts", "MMdd"), F.lit("scene"), F.lpad(F.hour("ts").cast("string"), 3, "0"))
    subjects = F.when(e % 19 == 0, F.array().cast("array<string>")).when(e % 2 == 0, F.array(F.concat(F.lit("S"), u % 7), F.concat(F.lit("T"), u % 5))).otherwise(F.array(F.concat(F.lit("S"), u % 7)))
    text = F.when(e % 41 == 0, "All").when(e % 43 == 0, F.concat(F.lit("Unknown "), e)).when(e % 47 == 0, F.concat(F.lit("All left "), e)).otherwise(F.concat(F.lit("Ev "), F.when(e % 6 == 1, e - 1).otherwise(e)))
    place = F.when(e % 37 == 0, "").when(F.col("value") > 200, "unknown room").otherwise(F.concat("event_type", F.when(u % 3 == 0, " Hall").otherwise(" Bar")))
    return t("events").select(
        F.date_format("ts", "MMdd").alias("episode"), F.concat(scene, F.lit("_event_"), F.lpad(e.cast("string"), 9, "0")).alias("event_id"), text.alias("description"), place.alias("location"),
        subjects.alias("subjects"), F.when(e % 11 == 0, "").otherwise(scene).alias("clip"), F.concat(F.date_format("ts", "HH:mm:ss"), F.lit("-00:00:00")).alias("started"),
    )


_E = """
WITH e AS (SELECT strftime(ts, '%m%d') episode, strftime(ts, '%m%d') || '_scene_' || lpad(hour(ts)::VARCHAR, 3, '0') || '_event_' || lpad(event_id::VARCHAR, 9, '0') event_id,
CASE WHEN event_id % 41 = 0 THEN 'All' WHEN event_id % 43 = 0 THEN 'Unknown ' || event_id WHEN event_id % 47 = 0 THEN 'All left ' || event_id ELSE 'Ev ' || CASE WHEN event_id % 6 = 1 THEN event_id - 1 ELSE event_id END END description,
CASE WHEN event_id % 37 = 0 THEN '' WHEN value > 200 THEN 'unknown room' ELSE event_type || CASE WHEN user_id % 3 = 0 THEN ' Hall' ELSE ' Bar' END END AS location,
CASE WHEN event_id % 19 = 0 THEN [] WHEN event_id % 2 = 0 THEN ['S' || (user_id % 7), 'T' || (user_id % 5)] ELSE ['S' || (user_id % 7)] END subjects,
CASE WHEN event_id % 11 = 0 THEN '' ELSE strftime(ts, '%m%d') || '_scene_' || lpad(hour(ts)::VARCHAR, 3, '0') END clip, strftime(ts, '%H:%M:%S') AS started, epoch(ts)::BIGINT % 86400 AS start FROM events),
vd AS (SELECT *, lower(trim(description)) <> 'all' AND NOT starts_with(lower(trim(description)), 'unknown') AS valid FROM e)
"""
_SLOT = "(('0x' || md5(event_id || '|{s}')[1:8])::BIGINT % 4)::INT"


def _made(kind: str, salt: str) -> str:
    """Finishes the attempts a(episode, event_id, question, answer, others): the questions of one family."""
    key = "lower(trim({}))"
    fine = "len(others) >= 3 AND " + " AND ".join(f"{key.format(x)} <> 'all' AND NOT starts_with({key.format(x)}, 'unknown') AND {x} <> ''" for x in ("answer", "others[1]", "others[2]", "others[3]"))
    apart = f"len(list_distinct([{key.format('answer')}, {key.format('others[1]')}, {key.format('others[2]')}, {key.format('others[3]')}])) = 4"
    text = "NOT regexp_matches(lower(question), '\\ball\\b') AND NOT contains(lower(question), 'unknown')"
    options = "array_to_string(list_concat(list_concat(others[1:slot], [answer]), others[slot + 1:3]), '|')"
    return f"SELECT episode, event_id, '{kind}' kind, question, {options} AS options, slot AS answer_index FROM (SELECT *, {_SLOT.format(s=salt)} slot FROM a WHERE {fine} AND {apart} AND {text})"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.where("ok").select("episode", "event_id", "kind", "question", F.array_join("options", "|").alias("options"), "answer_index")


@query(_E + """, p AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY md5(p) || '|' || p) - 1 seat, count(*) OVER (PARTITION BY episode) n FROM (SELECT DISTINCT episode, location p FROM e WHERE location <> '' AND NOT starts_with(location, 'unknown'))),
d AS (SELECT e.event_id, p, k FROM e JOIN (SELECT DISTINCT episode, n FROM p) z USING (episode), range(0, 4) r(k), p WHERE p.seat = (('0x' || md5(event_id)[1:8])::BIGINT + k) % z.n AND p.episode = e.episode AND k < z.n AND e.location <> p AND e.location <> '' AND NOT starts_with(e.location, 'unknown')),
o AS (SELECT event_id, list(p ORDER BY k)[1:3] others FROM d GROUP BY 1), a AS (SELECT episode, event_id, 'Where did ' || lower(description) || ' when ' || array_to_string(subjects, ' and ') || ' were present?' question, location AS answer, others FROM e JOIN o USING (event_id) WHERE location <> '' AND len(subjects) > 0)
""" + _made("location", "L"))  # fmt: skip
def recall_location(t):
    return _shown(S.location_recall(story_events(t)))


@query(_E + """, f AS (SELECT episode, location, event_id o, array_to_string(list_sort(subjects), ', ') n, row_number() OVER (PARTITION BY episode, location ORDER BY event_id) rn FROM e WHERE len(subjects) > 0),
b AS (SELECT x.event_id, n, o, row_number() OVER (PARTITION BY x.event_id ORDER BY o) k FROM e x JOIN f USING (episode, location) WHERE rn <= 4 AND o <> x.event_id),
c AS (SELECT b.event_id, n, min(o) o FROM b JOIN e x USING (event_id) WHERE k <= 3 AND n <> array_to_string(list_sort(x.subjects), ', ') GROUP BY ALL),
g AS (SELECT x.episode, x.event_id, x.location, x.description, x.subjects, coalesce((SELECT list(n ORDER BY o) FROM c WHERE c.event_id = x.event_id), []) l FROM e x WHERE x.location <> '' AND len(x.subjects) > 0),
a AS (SELECT episode, event_id, 'Who was present at ' || location || ' when ' || lower(description) || '?' question, array_to_string(list_sort(subjects), ', ') answer, CASE WHEN len(l) < 3 AND len(subjects) > 1 THEN list_concat(l, [subjects[1]]) ELSE l END others FROM g)
""" + _made("subject", "S"))  # fmt: skip
def recall_subject(t):
    return _shown(S.subject_recall(story_events(t)))


@query(_E + """, f AS (SELECT episode, location, event_id o, description n, row_number() OVER (PARTITION BY episode, location ORDER BY event_id) rn FROM vd WHERE valid),
b AS (SELECT x.event_id, n, o, row_number() OVER (PARTITION BY x.event_id ORDER BY o) k FROM e x JOIN f USING (episode, location) WHERE rn <= 4 AND o <> x.event_id), l AS (SELECT event_id, list(n ORDER BY o) others FROM b WHERE k <= 3 GROUP BY 1),
a AS (SELECT episode, event_id, 'What happened at ' || location || ' when ' || array_to_string(subjects, ' and ') || ' were together?' question, description answer, others FROM e JOIN l USING (event_id) WHERE location <> '' AND len(subjects) > 0)
""" + _made("event", "E"))  # fmt: skip
def recall_event(t):
    return _shown(S.event_recall(story_events(t)))


@query(_E + """, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY md5(event_id || '|bool'), event_id) rn, count(*) OVER (PARTITION BY episode) n FROM e) WHERE rn <= greatest(1, n // 5)),
p AS (SELECT *, row_number() OVER (PARTITION BY episode, kind ORDER BY md5(x) || '|' || x) - 1 seat, count(*) OVER (PARTITION BY episode, kind) size FROM (SELECT DISTINCT episode, 'place' kind, location x FROM e WHERE location <> '' UNION SELECT DISTINCT episode, 'person', unnest(subjects) FROM e)),
c AS (SELECT event_id, kind, x, row_number() OVER (PARTITION BY event_id, kind ORDER BY (seat - ('0x' || md5(event_id)[1:8])::BIGINT % size + size) % size) k FROM s JOIN p USING (episode) WHERE CASE WHEN kind = 'place' THEN x <> s.location ELSE NOT list_contains(s.subjects, x) END)
SELECT episode, event_id, kind, CASE WHEN kind = 'place' THEN 'Did ' || lower(description) || ' at ' || x || '?' ELSE 'Was ' || x || ' present when ' || lower(description) || '?' END question, CASE WHEN z = 1 THEN 'Yes|No' ELSE 'No|Yes' END AS options, z AS answer_index
FROM (SELECT s.episode, s.event_id, s.description, kind, x, (('0x' || md5(s.event_id || '|' || kind)[1:8])::BIGINT % 2)::INT z FROM s JOIN c USING (event_id) WHERE k = 1)""")  # fmt: skip
def boolean_recall(t):
    return _shown(S.boolean_questions(story_events(t)))


@query(_E + """, ep AS (SELECT episode, count(*) own, row_number() OVER (ORDER BY episode) AS seat FROM e GROUP BY 1), sp AS (SELECT ep.episode, seat, own, s FROM ep, range(1, 4) r(s) WHERE seat >= s AND own >= 2),
v AS (SELECT sp.episode, s, x.event_id, x.description, row_number() OVER (PARTITION BY sp.episode, s ORDER BY x.event_id) - 1 pos, count(*) OVER (PARTITION BY sp.episode, s) n, lower(trim(x.description)) <> 'all' AND NOT starts_with(lower(trim(x.description)), 'unknown') AS valid FROM sp JOIN ep p ON p.seat BETWEEN sp.seat - s + 1 AND sp.seat JOIN e x ON x.episode = p.episode),
q AS (SELECT episode, s, n, k, CASE WHEN n > 3 THEN least(k * greatest(1, n // (least(2, n - 1) + 1)), n // 2) ELSE 0 END i, CASE WHEN n > 3 THEN least(least(k * greatest(1, n // (least(2, n - 1) + 1)), n // 2) + greatest(1, n // (least(2, n - 1) + 1)) + k, n - 1) ELSE n - 1 END j FROM (SELECT DISTINCT episode, s, n FROM v), range(0, 2) r(k) WHERE k < n - 1 AND n >= 2),
ab AS (SELECT q.episode, q.s, q.k, a.event_id, a.description answer, b.event_id b_id, b.description b_text FROM q JOIN v a ON a.episode = q.episode AND a.s = q.s AND a.pos = q.i JOIN v b ON b.episode = q.episode AND b.s = q.s AND b.pos = q.j),
o AS (SELECT ab.episode, ab.s, ab.k, v.description, v.pos, row_number() OVER (PARTITION BY ab.episode, ab.s, ab.k ORDER BY v.pos) rn FROM ab JOIN v USING (episode, s) WHERE v.valid AND v.event_id NOT IN (ab.event_id, ab.b_id)),
a AS (SELECT ab.episode, ab.event_id, s, k, 'What happened before ' || lower(any_value(b_text)) || '?' question, any_value(answer) answer, list(o.description ORDER BY o.pos) others FROM ab JOIN o USING (episode, s, k) WHERE rn <= 3 GROUP BY ALL)
""" + _made("order", "T").replace("SELECT episode,", "SELECT s::INT AS span, k::INT AS question_no, episode,", 1))  # fmt: skip
def temporal_pairs(t):
    rows = S.temporal_ordering(story_events(t)).where("ok")
    return rows.select("episode", "event_id", "span", "question_no", "kind", "question", F.array_join("options", "|").alias("options"), "answer_index")


_LATEST = """, l AS (SELECT *, row_number() OVER (PARTITION BY episode, location ORDER BY event_id DESC) r, min(event_id) OVER (PARTITION BY episode, location) seen, count(*) OVER (PARTITION BY episode, location) n FROM vd WHERE location <> ''),
o AS (SELECT episode, location, list(description ORDER BY event_id) others FROM (SELECT *, row_number() OVER (PARTITION BY episode, location ORDER BY event_id DESC) k FROM l WHERE r > 1 AND valid) WHERE k <= 3 GROUP BY ALL),
a0 AS (SELECT l.episode, l.event_id, seen, 'What was the last event that happened at ' || l.location || ' in this episode?' question, description answer, others FROM l JOIN o USING (episode, location) WHERE r = 1 AND n >= 2),
w AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY event_id DESC) r FROM vd), wo AS (SELECT episode, list(description ORDER BY event_id) others FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY event_id DESC) k FROM w WHERE r > 1 AND valid) WHERE k <= 3 GROUP BY 1),
a1 AS (SELECT episode, event_id, '' seen, 'What was the most recent event that occurred in the episode?' question, description answer, others FROM w JOIN wo USING (episode) WHERE r = 1)
"""


@query(_E + _LATEST + ", z0 AS (" + _made("latest_place", "P").replace("FROM a WHERE", "FROM a0 WHERE").replace("SELECT episode,", "SELECT seen, episode,", 1) + "), z1 AS (" + _made("latest_episode", "W").replace("FROM a WHERE", "FROM a1 WHERE") + ") SELECT * EXCLUDE (seen, rn) FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY seen) rn FROM z0) WHERE rn = 1 UNION ALL SELECT * FROM z1")
def latest_questions(t):
    return _shown(S.latest_events(story_events(t)))


@query(_E + """, x AS (SELECT episode, event_id, description, location, start, string_split(event_id, '_')[3] scene FROM vd WHERE valid AND location <> '' AND NOT starts_with(location, 'unknown')),
p AS (SELECT episode, location, count(*) n, count(DISTINCT scene) scenes, min(event_id) seen FROM x GROUP BY ALL HAVING count(*) >= 4), p2 AS (SELECT *, max((scenes > 1)::INT) OVER (PARTITION BY episode) b FROM p),
p3 AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY seen) turn FROM p2 WHERE scenes > 1 OR b = 0), m AS (SELECT x.*, turn, row_number() OVER (PARTITION BY x.episode, x.location ORDER BY md5(event_id || '|seq'), event_id) d FROM x JOIN p3 USING (episode, location) WHERE turn <= 2),
m2 AS (SELECT *, row_number() OVER (PARTITION BY episode, location, scene ORDER BY d) f FROM m), m3 AS (SELECT *, row_number() OVER (PARTITION BY episode, location ORDER BY CASE WHEN d <= 8 AND f = 1 THEN d ELSE d + 1000000000 END) AS label FROM m2),
h AS (SELECT episode, location, turn::INT turn, list(label ORDER BY start, label) rt, list(event_id ORDER BY label) related, string_agg('"event_' || label || '": ' || description, chr(10) ORDER BY label) lines FROM m3 WHERE label <= 4 GROUP BY ALL),
n AS (SELECT [a, b, c, d] pm FROM range(1, 5) t1(a), range(1, 5) t2(b), range(1, 5) t3(c), range(1, 5) t4(d) WHERE a <> b AND a <> c AND a <> d AND b <> c AND b <> d AND c <> d),
w AS (SELECT episode, location, pm, row_number() OVER (PARTITION BY episode, location ORDER BY md5(episode || '|' || location || '|' || array_to_string(pm, ','))) k FROM h, n WHERE array_to_string(pm, ',') <> array_to_string(rt, ',')),
u AS (SELECT episode, location, list(array_to_string(list_transform(pm, lambda i: 'event_' || i), ', ') ORDER BY k) o FROM w WHERE k <= 3 GROUP BY ALL),
z AS (SELECT *, (('0x' || md5(episode || '|' || location || '|slot')[1:8])::BIGINT % 4)::INT answer_index, array_to_string(list_transform(rt, lambda i: 'event_' || i), ', ') r FROM h JOIN u USING (episode, location)),
y AS (SELECT *, list_concat(list_concat(o[1:answer_index], [r]), o[answer_index + 1:]) al FROM z)
SELECT episode, location, turn, 'Here are a series of 4 events. Arrange them in the correct temporal order in which they occurred at ' || location || '.' || chr(10) || chr(10) || lines question, 'A. ' || al[1] || '|B. ' || al[2] || '|C. ' || al[3] || '|D. ' || al[4] AS options, answer_index, array_to_string(related, ',') related FROM y""")  # fmt: skip
def place_sequence(t):
    rows = S.place_sequences(story_events(t))
    return rows.select("episode", "location", "turn", "question", F.array_join("options", "|").alias("options"), "answer_index", F.array_join("related", ",").alias("related"))


@query(None)
def all_questions(t):
    return S.numbered_questions(story_events(t)).select("question_id", "kind", "episode", "question", F.array_join("options", "|").alias("options"), "answer_index", F.array_join("related", ",").alias("related"))


_REPLY = """WITH e AS (SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN 'fence' WHEN 1 THEN 'bare' WHEN 2 THEN 'broken' WHEN 3 THEN 'odd' ELSE 'none' END kind, strftime(ts, '%m%d') ep, hour(ts)::INT sc FROM events)
SELECT event_id, CASE kind WHEN 'fence' THEN ep || '_scene_' || lpad(sc::VARCHAR, 3, '0') || '_event_001;Ev ' || event_id || ';S1;Perk;00:00:01-00:09:00;c|' || ep || '_scene_' || lpad(sc::VARCHAR, 3, '0') || '_event_004;t2 and S1 left;S1,T2;Perk;00:01:00-00:09:00;' || ep || '_scene_' || lpad(sc::VARCHAR, 3, '0')
WHEN 'bare' THEN ep || '_scene_' || lpad(sc::VARCHAR, 3, '0') || '_event_001;x;;Perk;00:01:00-7;' || ep || '_scene_' || lpad(sc::VARCHAR, 3, '0')
WHEN 'odd' THEN ep || '_scene_' || lpad(sc::VARCHAR, 3, '0') || '_event_001;first;;Perk;00:01:00-00:09:00;' || ep || '_scene_' || lpad(sc::VARCHAR, 3, '0') ELSE '' END AS found FROM e"""


@query(_REPLY)
def events_from_replies(t):
    e = F.col("event_id")
    fence = F.concat(F.lit('Sure! [here]\n```json\n[{"event_description": " Ev '), e, F.lit(' ", "involved_subjects": ["S1 ", "X"], "start_offset": "00:00:01", "episode_clip": "c"}, 5, {"event_description": "  "}, {"event_description": "t2 and S1 left", "involved_subjects": "S1"}]\n```\nbye ]'))
    reply = F.when(e % 5 == 0, fence).when(e % 5 == 1, 'ok: [{"event_description": "x", "involved_subjects": ["Z"], "end_offset": 7}] fine').when(e % 5 == 2, '[{"event_description": "x"]').when(e % 5 == 3, '[{"event_description": "first"}, {"event_description": 3}, {"event_description": "third"}]').otherwise("no events")
    found = Y.events_from_text(reply, F.date_format("ts", "MMdd"), F.hour("ts"), F.lit("Perk"), F.array(F.lit("S1"), F.lit("T2")), F.lit("00:01:00"), F.lit("00:09:00"))
    line = lambda x: F.concat_ws(";", x["event_id"], x["event_description"], F.array_join(x["involved_subjects"], ","), x["location"], x["timestamp"], x["episode_clip"])
    return t("events").select("event_id", F.array_join(F.transform(found, line), "|").alias("found"))


@query("""SELECT conv_id, scene::BIGINT scene, row_number() OVER (PARTITION BY conv_id ORDER BY scene) AS scene_no, n, CASE WHEN conv_id % 3 = 0 THEN '00:0' || (conv_id % 7) ELSE '' END clip_start, CASE WHEN conv_id % 4 = 0 THEN '' ELSE (conv_id % 4)::VARCHAR END srt_start, conv_id % 3 = 0 OR conv_id % 4 <> 0 AS timed
FROM (SELECT conv_id, scene, count(*) FILTER (role <> 'user') n FROM (SELECT *, sum((starts_with(line, '[Scene:') OR starts_with(line, '[Opening') OR starts_with(line, '[Closing'))::INT) OVER (PARTITION BY conv_id ORDER BY turn) scene FROM (SELECT *, CASE WHEN role = 'user' THEN CASE turn % 3 WHEN 0 THEN '[Scene: x]' WHEN 1 THEN '[Opening' ELSE '[scene: y' END ELSE role END line FROM conversations)) GROUP BY ALL) WHERE n > 0""")
def scene_numbers(t):
    from pyspark.sql import Window

    line = F.when(F.col("role") == "user", F.when(F.col("turn") % 3 == 0, "[Scene: x]").when(F.col("turn") % 3 == 1, "[Opening").otherwise("[scene: y")).otherwise(F.col("role"))
    rows = t("conversations").withColumn("line", line).withColumn("scene", F.sum(Y.is_header(F.col("line")).cast("int")).over(Window.partitionBy("conv_id").orderBy("turn")))
    scenes = rows.groupBy("conv_id", "scene").agg(F.count_if(F.col("role") != "user").alias("n")).where("n > 0")
    c = F.col("conv_id")
    raw = F.struct(F.when(c % 3 == 0, F.concat(F.lit("00:0"), c % 7)).alias("clip_start"), F.lit(None).cast("string").alias("clip_end"), (c % 4).cast("string").alias("srt_start"), F.lit("0").alias("srt_end"))
    out = scenes.withColumn("scene_no", F.row_number().over(Window.partitionBy("conv_id").orderBy("scene"))).withColumn("_t", Y.timing(raw)).withColumn("timed", Y.has_timing(F.array(raw)))
    return out.select("conv_id", "scene", F.col("scene_no").cast("long").alias("scene_no"), "n", "_t.clip_start", "_t.srt_start", "timed")


@query("""SELECT event_id, '/v/season_' || month(ts) || '/episode_' || day(ts) || '.mp4' AS path, chr(10) || chr(10) || 'Video Context (Subtitles):' || chr(10) || event_type || chr(10) || chr(10) || 'Question:' || chr(10) || 'Q' || event_id || chr(10) || chr(10) || 'Answer Options:' || chr(10) || 'A. x' || chr(10) || 'B. y' || chr(10) || 'Respond only with the alphabet or number of the correct multiple-choice answer option (e.g., A).' || chr(10) || chr(10) AS prompt,
CASE WHEN event_id % 2 = 0 THEN 'R: hi' || chr(10) || 'J: ' || event_type ELSE 'J: ' || event_type END said FROM events""")
def prompts(t):
    scene = lambda key, *turns: F.struct(F.array(*(F.struct(F.lit(s).alias("speaker"), w.alias("text")) for s, w in turns)).alias("dialogue"), F.array(F.struct(key.alias("event_id"))).alias("events"))
    scenes = F.array(scene(F.lit("a"), ("R", F.lit("hi")), (" ", F.lit("x"))), scene(F.lit("b"), ("J", F.col("event_type")), ("K", F.lit("  "))), scene(F.lit("c"), ("Z", F.lit("no"))))
    related = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("q")))
    return t("events").select(
        "event_id", F.array_join(Y.video_paths(F.array(F.date_format("ts", "MMdd")), "/v/"), ",").alias("path"), Y.answer_prompt(F.concat(F.lit("Q"), "event_id"), F.array(F.lit("A. x"), F.lit("y")), F.col("event_type")).alias("prompt"), Y.subtitles(scenes, related).alias("said")
    )
