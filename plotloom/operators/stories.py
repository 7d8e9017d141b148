"""Multiple-choice questions from the events of episodes.

Events are rows (episode, event_id, description, location, subjects, clip, started); an event_id starts with its episode's and sorts
in story order. Random draws are MD5 orders, so that a table always gives the same questions. Each family returns its attempts: ``ok`` is
false for those that give no question, which still use up a number.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotloom.functions import text as T
from plotloom.functions.numbers import to_seconds
from plotloom.operators.prefix import running
from plotloom.operators.relate import in_order, ring_draws, ring_pick

QUESTION = ("episode", "event_id", "kind", "question", "options", "answer_index", "related", "clips", "ok")


def drawn(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))


def slot_of(*parts: Column | str, slots: int = 4) -> Column:
    """A repeatable place from 0 to slots - 1."""
    return (F.conv(F.substring(drawn(*parts), 1, 8), 16, 10).cast("long") % slots).cast("int")


def with_slot(answer: Column, others: Column, slot: Column) -> Column:
    """The answer in its place among the others, which keep their order."""
    return F.array_insert(F.slice(others, 1, 3), slot + 1, answer)


def choices(answer: Column, others: Column) -> Column:
    """The answer and the others without invalid options and repeats (trimmed, in any case), four at most."""
    return F.slice(T.ordered_distinct(F.concat(F.array(answer), others)), 1, 4)


def _finished(rows: DataFrame, kind: str, salt: str) -> DataFrame:
    """Attempts from (episode, event_id, question, answer, others, related, clips): four valid options and a valid text make a question."""
    options = choices(F.col("answer"), F.col("others"))
    slot = slot_of(F.col("event_id"), salt)
    ok = T.valid_text(F.col("question")) & (F.size("others") >= 3) & (F.size("_o") == 4) & (F.get("_o", 0) == F.col("answer"))
    out = rows.withColumn("_o", options).withColumn("ok", F.coalesce(ok, F.lit(False)))
    made = F.when(F.col("ok"), with_slot(F.col("answer"), F.slice("_o", 2, 3), slot))
    return out.select("episode", "event_id", F.lit(kind).alias("kind"), "question", made.alias("options"), F.when(F.col("ok"), slot).alias("answer_index"), "related", "clips", "ok")


def _single(events: DataFrame) -> DataFrame:
    clips = F.when(F.col("clip") != "", F.array("clip")).otherwise(F.array().cast("array<string>"))
    return events.withColumn("related", F.array("event_id")).withColumn("clips", clips)


def _askable(events: DataFrame) -> DataFrame:
    return _single(events).where((F.col("location") != "") & (F.size("subjects") > 0))


def _names(subjects: Column) -> Column:
    return F.array_join(F.array_sort(subjects), ", ")


def first_of_group(rows: DataFrame, keys: list[str], order: str, k: int, *values: str) -> DataFrame:
    """(*keys, first): the ``k`` first of each group, in order, as structs (order, *values)."""
    by = Window.partitionBy(*keys).orderBy(order)
    few = rows.select(*keys, order, *values).withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") <= k)
    return few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("first"))


def location_recall(events: DataFrame) -> DataFrame:
    """Where an event was, against three other valid places of its episode."""
    valid = events.where(T.valid_option(F.col("location"))).select("episode", "event_id", "location")
    others = ring_draws(valid, "event_id", ["episode"], "location", 3).select("event_id", "others")
    text = F.concat(F.lit("Where did "), F.lower("description"), F.lit(" when "), F.array_join("subjects", " and "), F.lit(" were present?"))
    rows = _askable(events).join(others, "event_id", "left").withColumn("others", F.coalesce("others", F.array().cast("array<string>")))
    return _finished(rows.withColumn("question", text).withColumn("answer", F.col("location")), "location", "L")


def subject_recall(events: DataFrame) -> DataFrame:
    """Who was present, against the companies of the first three other events there, and this one's without its last member."""
    first = first_of_group(events.where(F.size("subjects") > 0), ["episode", "location"], "event_id", 4, "subjects")
    text = F.concat(F.lit("Who was present at "), "location", F.lit(" when "), F.lower("description"), F.lit("?"))
    rows = _askable(events).join(first, ["episode", "location"]).withColumn("answer", _names(F.col("subjects")))
    near = F.transform(F.slice(F.filter("first", lambda e: e["event_id"] != F.col("event_id")), 1, 3), lambda e: _names(e["subjects"]))
    apart = F.array_distinct(F.filter(near, lambda n: (n != F.col("answer")) & T.valid_option(n)))
    fewer = F.array_join(F.slice("subjects", 1, F.greatest(F.size("subjects") - 1, F.lit(0))), ", ")
    more = F.when((F.size("_a") < 3) & (F.size("subjects") > 1) & T.valid_option(fewer), F.concat("_a", F.array(fewer))).otherwise(F.col("_a"))
    return _finished(rows.withColumn("question", text).withColumn("_a", apart).withColumn("others", F.slice(more, 1, 3)), "subject", "S")


def event_recall(events: DataFrame) -> DataFrame:
    """What happened, against the first three other events of the place."""
    first = first_of_group(events.where(T.valid_option(F.col("description"))), ["episode", "location"], "event_id", 4, "description")
    text = F.concat(F.lit("What happened at "), "location", F.lit(" when "), F.array_join("subjects", " and "), F.lit(" were together?"))
    rows = _askable(events).join(first, ["episode", "location"], "left").withColumn("first", F.coalesce("first", F.array().cast("array<struct<event_id:string,description:string>>")))
    others = F.transform(F.slice(F.filter("first", lambda e: e["event_id"] != F.col("event_id")), 1, 3), lambda e: e["description"])
    return _finished(rows.withColumn("question", text).withColumn("answer", F.col("description")).withColumn("others", others), "event", "E")


def boolean_questions(events: DataFrame) -> DataFrame:
    """Of a fifth of each episode's events: was it at another place, was an absent person there? The right answer is always No.

    Places and people are picked from rings, so an episode's events don't meet all its places and people, and no row holds them.
    """
    sample = running(_single(events).withColumn("_h", drawn(F.col("event_id"), "bool")), ["_h", "event_id"], place="_at", size="_n", by=["episode"])
    sample = sample.where(F.col("_at") < F.greatest(F.lit(1), F.floor(F.col("_n") / 5))).drop("_h", "_at", "_n")
    places = events.where(F.col("location") != "").select("episode", F.col("location").alias("place"))
    rows = ring_pick(sample, places, "event_id", ["episode"], "place", F.lit(1), F.col("place") != F.col("location"))
    people = events.select("episode", F.explode("subjects").alias("person"))
    rows = ring_pick(rows, people, "event_id", ["episode"], "person", F.size("subjects"), ~F.array_contains("subjects", F.col("person")))
    low = F.lower("description")
    asked = F.array(
        F.struct(F.lit("place").alias("kind"), F.concat(F.lit("Did "), low, F.lit(" at "), "place", F.lit("?")).alias("question")),
        F.struct(F.lit("person").alias("kind"), F.concat(F.lit("Was "), "person", F.lit(" present when "), low, F.lit("?")).alias("question")),
    )
    out = rows.select("episode", "event_id", "related", "clips", F.explode(F.filter(asked, lambda q: q["question"].isNotNull())).alias("q"))
    no = slot_of(F.col("event_id"), F.col("kind"), slots=2)
    return out.select("episode", "event_id", "q.kind", "q.question", "related", "clips").select(
        "episode", "event_id", "kind", "question", F.when(no == 1, F.array(F.lit("Yes"), F.lit("No"))).otherwise(F.array(F.lit("No"), F.lit("Yes"))).alias("options"), no.alias("answer_index"), "related", "clips", F.lit(True).alias("ok")
    )


def pair_places(n: Column, k: Column, asked: Column) -> tuple[Column, Column]:
    """The places (i, j) of question k's two events among n in order."""
    step = F.greatest(F.lit(1), F.floor(n / (asked + 1)))
    i = F.least(k * step, F.floor(n / 2))
    return F.when(n > 3, i).otherwise(0).cast("int"), F.when(n > 3, F.least(i + step + k, n - 1)).otherwise(n - 1).cast("int")


def temporal_ordering(events: DataFrame, spans: int = 3, asked: int = 2) -> DataFrame:
    """What happened before an event, in this episode and up to spans - 1 before it; adds ``span`` and ``question_no``.

    Only the places that a question needs are looked up: events are numbered inside their episode, and an episode's first place
    in a span is the number of events of the span's earlier episodes.
    """
    numbered = events.withColumn("_rn", F.row_number().over(Window.partitionBy("episode").orderBy("event_id")) - 1)
    counts = events.groupBy("episode").agg(F.count("*").alias("own"))
    line = in_order(counts, "episode", "at")
    parts = line.select("episode", "at", "own", F.explode(F.sequence(F.lit(1), F.lit(spans))).alias("span")).select("episode", "own", "span", F.explode(F.sequence(F.col("at") - F.col("span") + 1, F.col("at"))).alias("at"))
    parts = parts.join(line.select("at", F.col("episode").alias("part"), F.col("own").alias("part_rows")), "at")
    by = Window.partitionBy("episode", "span").orderBy("at")
    parts = parts.withColumn("first", F.sum("part_rows").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("part_rows"))
    held = parts.groupBy("episode", "span").agg(F.max("own").alias("own"), F.count("*").alias("k"), F.sum("part_rows").alias("n"), F.array_sort(F.collect_list(F.struct("first", "part", "part_rows"))).alias("parts"))
    held = held.where((F.col("k") == F.col("span")) & (F.col("own") >= 2) & (F.col("n") >= 2))
    limit = F.least(F.lit(asked), F.col("n") - 1).cast("int")
    asks = held.withColumn("question_no", F.explode(F.sequence(F.lit(0), limit - 1)))
    i, j = pair_places(F.col("n"), F.col("question_no"), limit)
    asks = asks.withColumn("i", i).withColumn("j", j)
    wanted = asks.select("episode", "span", "question_no", "parts", F.posexplode(F.array("i", "j")).alias("side", "place"))
    home = F.filter("parts", lambda p: (p["first"] <= F.col("place")) & (F.col("place") < p["first"] + p["part_rows"]))[0]
    wanted = wanted.withColumn("_p", home).select("episode", "span", "question_no", "side", F.col("_p.part").alias("part"), (F.col("place") - F.col("_p.first")).alias("_rn"))
    found = wanted.join(numbered.select(F.col("episode").alias("part"), "_rn", "event_id", "description", "clip"), ["part", "_rn"])
    pair = found.groupBy("episode", "span", "question_no").agg(*(F.max(F.when(F.col("side") == s, F.struct("event_id", "description", "clip"))).alias(c) for s, c in ((0, "a"), (1, "b"))))
    # of each episode the five first valid events are enough for three distractors besides a and b
    early = first_of_group(events.where(T.valid_option(F.col("description"))), ["episode"], "event_id", 5, "description").select(F.col("episode").alias("part"), "first")
    pool = asks.select("episode", "span", F.explode("parts").alias("p")).distinct().select("episode", "span", F.col("p.part").alias("part")).join(early, "part")
    pool = pool.groupBy("episode", "span").agg(F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, 5).alias("pool"))
    rows = pair.join(pool, ["episode", "span"], "left")
    others = F.transform(F.slice(F.filter("pool", lambda e: (e["event_id"] != F.col("a.event_id")) & (e["event_id"] != F.col("b.event_id"))), 1, 3), lambda e: e["description"])
    rows = rows.select(
        "episode", "span", "question_no", F.col("a.event_id").alias("event_id"), F.concat(F.lit("What happened before "), F.lower("b.description"), F.lit("?")).alias("question"), F.col("a.description").alias("answer"),
        F.coalesce(others, F.array().cast("array<string>")).alias("others"), F.array("a.event_id", "b.event_id").alias("related"), F.array_distinct(F.filter(F.array("a.clip", "b.clip"), lambda c: c != "")).alias("clips"),
    )
    keep = rows.select("episode", "event_id", "span", "question_no", "question", "answer", "others", F.struct("span", "question_no", "related").alias("related"), "clips")
    out = _finished(keep, "order", "T")
    return out.select("episode", "event_id", "kind", "question", "options", "answer_index", F.col("related.related").alias("related"), "clips", "ok", F.col("related.span").alias("span"), F.col("related.question_no").alias("question_no"))


def latest_events(events: DataFrame) -> DataFrame:
    """The last event of the first place (by first sight) that gives a question, and of the episode; adds ``tried``, the place's turn.

    The distractors are the last three valid events before it. Places are tried until one succeeds; later ones are no attempts.
    """
    valid = T.valid_option(F.col("description"))

    def last(rows: DataFrame, keys: list[str]) -> DataFrame:
        by = Window.partitionBy(*keys)
        marked = rows.withColumn("_last", F.row_number().over(by.orderBy(F.desc("event_id")))).withColumn("valid", valid)
        near = marked.where("_last > 1 AND valid").withColumn("_rn", F.row_number().over(by.orderBy(F.desc("event_id")))).where("_rn <= 3")
        near = near.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "description"))), lambda e: e["description"]).alias("others"))
        ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("event_id").alias("seen")).where("n >= 2")
        final = marked.where("_last = 1").drop("_last", "valid").join(ends, keys).join(near, keys, "left")
        return final.withColumn("others", F.coalesce("others", F.array().cast("array<string>"))).withColumn("answer", F.col("description"))

    placed = last(_single(events).where(F.col("location") != ""), ["episode", "location"])
    text = F.concat(F.lit("What was the last event that happened at "), "location", F.lit(" in this episode?"))
    tries = _finished(placed.withColumn("question", text).withColumn("related", F.struct("seen", "related")), "latest_place", "P").withColumn("seen", F.col("related.seen")).withColumn("related", F.col("related.related"))
    turn = Window.partitionBy("episode").orderBy("seen")
    tries = tries.withColumn("tried", F.row_number().over(turn)).withColumn("_won", F.min(F.when(F.col("ok"), F.col("tried"))).over(Window.partitionBy("episode"))).where(F.col("_won").isNull() | (F.col("tried") <= F.col("_won"))).drop("_won", "seen")
    whole = last(_single(events), ["episode"]).withColumn("question", F.lit("What was the most recent event that occurred in the episode?"))
    return tries.unionByName(_finished(whole, "latest_episode", "W").withColumn("tried", F.lit(1 << 30)))


def place_sequences(events: DataFrame, asked: int = 2, size: int = 4) -> DataFrame:
    """Put ``size`` events of a place in order: (episode, location, question, options, answer_index, related, ok).

    Places with events of more than one scene and ``size`` events are taken, in the order of first sight; only if there is none, those with
    enough events. Of eight drawn events each new scene's comes first, the rest is drawn from all. Wrong orders are
    the first three of the drawn order of all others.
    """
    rows = events.where(T.valid_option(F.col("description")) & T.valid_option(F.col("location"))).withColumn("scene", F.coalesce(F.get(F.split("event_id", "_"), 2), F.lit("000")))
    rows = rows.withColumn("start", to_seconds(F.trim(F.get(F.split("started", "-"), 0))))
    places = rows.groupBy("episode", "location").agg(F.count("*").alias("n"), F.countDistinct("scene").alias("scenes"), F.min("event_id").alias("seen")).where(F.col("n") >= size)
    best = F.max((F.col("scenes") > 1).cast("int")).over(Window.partitionBy("episode"))
    places = places.withColumn("_b", best).where((F.col("scenes") > 1) | (F.col("_b") == 0)).withColumn("turn", F.row_number().over(Window.partitionBy("episode").orderBy("seen"))).where(F.col("turn") <= asked)
    mine = rows.join(places.select("episode", "location", "turn"), ["episode", "location"])
    by = Window.partitionBy("episode", "location")
    mine = mine.withColumn("_d", F.row_number().over(by.orderBy(drawn(F.col("event_id"), "seq"), "event_id"))).withColumn("_first", F.row_number().over(Window.partitionBy("episode", "location", "scene").orderBy("_d")))
    fresh = (F.col("_d") <= 2 * size) & (F.col("_first") == 1)
    order = F.when(fresh, F.col("_d")).otherwise(F.col("_d") + (1 << 40))
    mine = mine.withColumn("label", F.row_number().over(by.orderBy(order))).where(F.col("label") <= size)
    held = mine.groupBy("episode", "location", "turn").agg(F.array_sort(F.collect_list(F.struct("label", "event_id", "description", "start"))).alias("e"))
    right = F.transform(F.array_sort(F.transform("e", lambda x: F.struct(x["start"].alias("start"), x["label"].alias("label")))), lambda x: x["label"])
    every = F.array(*(F.array(*map(F.lit, p)) for p in permutations(range(1, size + 1))))
    held = held.withColumn("right", right)
    wrong = F.filter(every, lambda p: p != F.col("right"))
    wrong = F.transform(F.slice(F.array_sort(F.transform(wrong, lambda p: F.struct(drawn(F.col("episode"), F.col("location"), F.array_join(p, ",")).alias("h"), p.alias("p")))), 1, 3), lambda s: s["p"])
    slot = slot_of(F.col("episode"), F.col("location"), "slot")
    held = held.withColumn("_all", F.array_insert(wrong, slot + 1, F.col("right")))
    letter = lambda i: F.get(F.array(*map(F.lit, T.LETTERS)), i)
    options = F.transform("_all", lambda p, i: F.concat(letter(i), F.lit(". "), F.array_join(F.transform(p, lambda x: F.concat(F.lit("event_"), x)), ", ")))
    lines = F.array_join(F.transform("e", lambda x: F.concat(F.lit('"event_'), x["label"], F.lit('": '), x["description"])), "\n")
    text = F.concat(F.lit("Here are a series of "), F.size("e"), F.lit(" events. Arrange them in the correct temporal order in which they occurred at "), "location", F.lit(".\n\n"), lines)
    return held.select("episode", "location", "turn", text.alias("question"), options.alias("options"), slot.alias("answer_index"), F.transform("e", lambda x: x["event_id"]).alias("related"), F.lit(True).alias("ok"))


def numbered_questions(events: DataFrame, spans: int = 3, asked: int = 2) -> DataFrame:
    """All questions of all families with ids ``Q_<episode>_<number>``; attempts that give no question leave gaps."""
    none = lambda c: F.lit(None).cast(c)
    recall = [f(events).select(*QUESTION, F.lit(0).alias("family"), F.col("event_id").alias("o1"), F.lit(i).alias("o2")) for i, f in enumerate((location_recall, subject_recall, event_recall))]
    boolean = boolean_questions(events).select(*QUESTION, F.lit(1).alias("family"), F.col("event_id").alias("o1"), F.when(F.col("kind") == "place", 0).otherwise(1).alias("o2"))
    temporal = temporal_ordering(events, spans, asked).select(*QUESTION, F.lit(2).alias("family"), F.lpad(F.col("span").cast("string"), 3, "0").alias("o1"), F.col("question_no").alias("o2"))
    latest = latest_events(events).select(*QUESTION, F.lit(3).alias("family"), F.lit("").alias("o1"), F.col("tried").alias("o2"))
    orders = place_sequences(events, asked).select(
        "episode", none("string").alias("event_id"), F.lit("sequence").alias("kind"), "question", "options", "answer_index", "related", F.array().cast("array<string>").alias("clips"), "ok", F.lit(4).alias("family"), F.lit("").alias("o1"), F.col("turn").alias("o2")
    )
    every = reduce(DataFrame.unionByName, [*recall, boolean, temporal, latest, orders])
    number = F.row_number().over(Window.partitionBy("episode").orderBy("family", "o1", "o2"))
    return every.withColumn("question_id", F.concat(F.lit("Q_"), "episode", F.lit("_"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))).where("ok").drop("ok", "family", "o1", "o2")


def by_location(events: DataFrame) -> DataFrame:
    """(episode, location, events): each place's events in order; blank places are left out."""
    return events.where(F.coalesce(F.col("location"), F.lit("")) != "").groupBy("episode", "location").agg(F.array_sort(F.collect_list(F.struct("event_id", "description"))).alias("events"))


def question_statistics(questions: DataFrame) -> DataFrame:
    """(kind, name, n): the seven histograms of a question set, and how many there are; one shuffle of partial counts."""
    cell = lambda kind, name, where=None: F.struct(F.lit(kind).alias("kind"), (name if where is None else F.when(where, name)).alias("name"))
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    cells = F.array(
        cell("total", F.lit("total_questions")), cell("question_type", F.col("question_type")), cell("subcategory", F.col("subcategory")), cell("cue", F.concat("cues", F.lit(" -> "), "target"), F.col("cues") != ""), cell("target", F.col("target"), F.col("target") != ""),
        cell("episode_span", F.concat(size("episode_span"), F.lit(" episode(s)")), size("episode_span") > 0), cell("clip_span", F.concat(size("clip_span"), F.lit(" clip(s)")), size("clip_span") > 0),
        cell("answer", F.char(F.col("answer_index") + 65), F.col("answer_index").between(0, 3)),
    )
    return questions.select(F.explode(F.filter(cells, lambda c: c["name"].isNotNull())).alias("c")).groupBy("c.kind", "c.name").agg(F.count("*").alias("n"))
