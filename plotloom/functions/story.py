"""Column functions over scripts, scenes and the events that a language model writes down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotloom.functions.text import relabel_kept, strip, subjects_kept

# Fixed values of the rules.
HEADERS = ("[Scene:", "[Opening", "[Closing")
TIMES = ("clip_start", "clip_end", "srt_start", "srt_end")
EVENT = "struct<event_id:string,event_description:string,involved_subjects:array<string>,location:string,timestamp:string,episode_clip:string>"
ANSWER_ONLY = "Respond only with the alphabet or number of the correct multiple-choice answer option (e.g., A)."

#: What a model is asked for; a caller may give another text with the same fields.
EXTRACTION = """List up to {events} events of this scene as a JSON array.

Place: {location}
Present: {subjects}
Time: {start} to {end}
Scene: {scene}

{dialogue}

Each item has event_description (one action that the dialogue shows, with names), involved_subjects (only those who take part),
start_offset and end_offset (HH:MM:SS). Write the array and nothing else."""


def is_header(line: Column) -> Column:
    return F.coalesce(line.startswith(HEADERS[0]) | line.startswith(HEADERS[1]) | line.startswith(HEADERS[2]), F.lit(False))


def timing(scene: Column) -> Column:
    """The four times of a scene as text: missing is '', and so is a subtitle time of 0."""
    clip = lambda c: F.coalesce(scene[c].cast("string"), F.lit("")).alias(c)
    srt = lambda c: F.when(scene[c].cast("string") == "0", "").otherwise(F.coalesce(scene[c].cast("string"), F.lit(""))).alias(c)
    return F.struct(clip("clip_start"), clip("clip_end"), srt("srt_start"), srt("srt_end"))


def has_timing(scenes: Column) -> Column:
    """Whether any scene has any time that isn't missing, '' or 0."""
    held = lambda s: F.exists(F.array(*(s[c].cast("string") for c in TIMES)), lambda v: v.isNotNull() & (v != "") & (v != "0"))
    return F.coalesce(F.exists(scenes, lambda s: F.coalesce(held(s), F.lit(False))), F.lit(False))


def dialogue_text(dialogue: Column) -> Column:
    """``SPEAKER: words`` lines of the turns that have both."""
    turns = F.filter(F.coalesce(dialogue, F.array().cast("array<struct<speaker:string,text:string>>")), lambda d: d["speaker"].isNotNull() & d["text"].isNotNull())
    return F.array_join(F.transform(turns, lambda d: F.concat(d["speaker"], F.lit(": "), d["text"])), "\n")


def filled(template: str, **fields: Column) -> Column:
    """The template with each {name} replaced by a column; null is empty."""
    out, parts = template, []
    while "{" in out:
        head, _, rest = out.partition("{")
        name, _, out = rest.partition("}")
        parts += [F.lit(head), F.coalesce(fields[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(out))


def extraction_prompt(scene: Column, events: int = 10, template: str = EXTRACTION) -> Column:
    return filled(
        template, events=F.lit(events), location=F.coalesce(scene["location"], F.lit("Unknown")), subjects=F.array_join(scene["subjects"], ", "), start=scene["clip_start"], end=scene["clip_end"],
        scene=F.coalesce(scene["scene_description"], F.lit("N/A")), dialogue=dialogue_text(scene["dialogue"]),
    )


def answer_prompt(question: Column, options: Column, context: Column) -> Column:
    """The question of a retrieval model, with what was found, the lettered options and the order to name a letter."""
    return F.concat(F.lit("\n\nVideo Context (Subtitles):\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion:\n"), F.coalesce(question, F.lit("")), F.lit("\n\nAnswer Options:\n"), relabel_kept(options), F.lit(f"\n{ANSWER_ONLY}\n\n"))


def video_paths(span: Column, folder: str) -> Column:
    """``SSEE`` names as season_<s>/episode_<e>.mp4 under the folder."""
    number = lambda x, a, n: F.substring(x, a, n).cast("int")
    return F.transform(span, lambda x: F.concat(F.lit(f"{folder.rstrip('/')}/season_"), number(x, 1, 2), F.lit("/episode_"), number(x, 3, 20), F.lit(".mp4")))


def subtitles(scenes: Column, related: Column | None = None) -> Column:
    """The dialogue of all scenes, or of those with a related event, without blank speakers and texts, as lines."""
    some = scenes if related is None else F.filter(scenes, lambda s: F.arrays_overlap(F.transform(s["events"], lambda e: e["event_id"]), related))
    turns = F.flatten(F.transform(some, lambda s: s["dialogue"]))
    said = F.filter(turns, lambda d: (F.trim(d["speaker"]) != "") & (F.trim(d["text"]) != ""))
    return F.array_join(F.transform(said, lambda d: F.concat(d["speaker"], F.lit(": "), d["text"])), "\n")


def events_from_text(response: Column, episode: Column, scene_no: Column, location: Column, subjects: Column, start: Column, end: Column, most: int = 10) -> Column:
    """array<EVENT> from a model's free text.

    Code fences go, then everything outside the first '[' and the last ']'; what isn't a JSON array gives none. Items that aren't
    objects or have a blank description are passed over, but keep their number. An item whose description or subjects
    aren't text ends the list. Subjects outside the scene go; if none is left, those named in the description come. The first ``most`` stay.

    A reply is parsed once, as a variant, and its items are read from that. JSON that a variant doesn't take (an object that names a key twice, single quotes) is
    read item by item as text.
    """
    fenced = F.regexp_replace(F.regexp_replace(strip(response), r"(?s)^.*?```(?:json)?", ""), r"(?s)```.*$", "")
    text = F.regexp_extract(F.when(response.contains("```"), fenced).otherwise(strip(response)), r"(?s)\[.*\]", 0)
    fields = ("start_offset", "end_offset", "episode_clip")

    def item(x: Column, i: Column) -> Column:
        told, people = (F.try_variant_get(x, f"$.{name}", "variant") for name in ("event_description", "involved_subjects"))

        def read(v: Column) -> Column:
            said, named = F.schema_of_variant(v["told"]), F.schema_of_variant(v["people"])
            listed = F.coalesce(named.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
            return F.struct(
                (i + 1).alias("no"), (F.coalesce(~said.isin("STRING"), F.lit(False)) | (F.coalesce(named.startswith("ARRAY<"), F.lit(False)) & ~listed)).alias("odd"),
                strip(F.coalesce(F.when(said == "STRING", F.try_variant_get(v["told"], "$", "string")), F.lit(""))).alias("told"), F.when(listed, F.try_variant_get(v["people"], "$", "array<string>")).alias("people"),
                *(F.try_variant_get(x, f"$.{name}", "string").alias(name) for name in fields),
            )

        return F.when(F.schema_of_variant(x).startswith("OBJECT"), F.get(F.transform(F.array(F.struct(told.alias("told"), people.alias("people"))), read), 0))

    def found(v: Column) -> Column:
        return F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), item), lambda p: p.isNotNull())

    parsed = F.get(F.transform(F.array(F.struct(F.try_parse_json(text).alias("v"), text.alias("t"))), lambda b: F.when(b["v"].isNotNull(), found(b["v"])).when(b["t"] != "", _text_items(b["t"]))), 0)
    pad = lambda n: F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
    scene = F.concat(episode, F.lit("_scene_"), pad(scene_no))

    def event(p: Column) -> Column:
        listed = F.transform(F.coalesce(p["people"], F.array().cast("array<string>")), lambda s: strip(s))
        return F.struct(
            F.concat(scene, F.lit("_event_"), pad(p["no"])).alias("event_id"), p["told"].alias("event_description"), subjects_kept(listed, subjects, p["told"]).alias("involved_subjects"), F.coalesce(location, F.lit("")).alias("location"),
            F.concat(F.coalesce(p["start_offset"], start, F.lit("00:00:00")), F.lit("-"), F.coalesce(p["end_offset"], end, F.lit("00:00:00"))).alias("timestamp"), F.coalesce(p["episode_clip"], scene).alias("episode_clip"),
        )

    def kept(all_: Column) -> Column:
        end_ = F.coalesce(F.array_min(F.transform(F.filter(all_, lambda p: p["odd"]), lambda p: p["no"])), F.lit(1 << 30))
        return F.slice(F.transform(F.filter(F.transform(all_, lambda p: F.struct(p.alias("p"), end_.alias("end"))), lambda q: (q["p"]["told"] != "") & (q["p"]["no"] < q["end"])), lambda q: event(q["p"])), 1, most)

    return F.get(F.transform(F.array(F.coalesce(parsed, F.array().cast(f"array<{_ITEM}>"))), kept), 0)


_ITEM = "struct<no:int,odd:boolean,told:string,people:array<string>,start_offset:string,end_offset:string,episode_clip:string>"


def _text_items(text: Column) -> Column:
    """The items of a JSON array, read one by one as text."""
    body = "event_description string, involved_subjects array<string>, start_offset string, end_offset string, episode_clip string"
    kind = lambda x, path: F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(x), path, "variant")), F.lit("NONE"))
    people = lambda x: kind(x, "$.involved_subjects")
    odd = lambda x: ~kind(x, "$.event_description").isin("STRING", "NONE") | (people(x).startswith("ARRAY<") & ~people(x).isin("ARRAY<STRING>", "ARRAY<VOID>"))

    def item(x: Column, i: Column) -> Column:
        e = F.from_json(x, body)
        return F.when(
            F.coalesce(F.ltrim(x).startswith("{"), F.lit(False)),
            F.struct((i + 1).alias("no"), odd(x).alias("odd"), strip(F.coalesce(e["event_description"], F.lit(""))).alias("told"), e["involved_subjects"].alias("people"), *(e[n].alias(n) for n in ("start_offset", "end_offset", "episode_clip"))),
        )

    return F.filter(F.transform(F.from_json(text, "array<string>"), item), lambda p: p.isNotNull())
