"""Subtitles in clips and between the frames of a video."""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotloom.functions.numbers import from_seconds


def clip_spine(cues: DataFrame, length: float, totals: DataFrame | None = None) -> DataFrame:
    """(video_id, clip_no, seg_start, seg_end): the clips of each video, from 1; the total is the last cue's end unless ``totals`` (video_id, total) has one."""
    ends = cues.groupBy("video_id").agg(F.max("end_s").alias("total"))
    if totals is not None:
        given = totals.select("video_id", F.col("total").alias("_given"))
        ends = ends.join(given, "video_id", "full").select("video_id", F.coalesce("_given", "total").alias("total"))
    n = F.ceil(F.col("total") / length)
    spine = ends.where("total > 0").select("video_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return spine.select("video_id", (F.col("i") + 1).alias("clip_no"), (F.col("i") * F.lit(float(length))).alias("seg_start"), F.least((F.col("i") + 1) * F.lit(float(length)), F.col("total").cast("double")).alias("seg_end"))


def cues_in_clips(cues: DataFrame, spine: DataFrame, length: float) -> DataFrame:
    """(video_id, clip_no, pos, start_s, end_s, text): the cues of each clip, cut to it and counted from its start. A cue goes only to the clips it touches."""
    first, last = (F.floor(F.col(c) / length) + 1 for c in ("start_s", "end_s"))
    rows = cues.withColumn("clip_no", F.explode(F.sequence(first, F.greatest(first, last)))).join(spine, ["video_id", "clip_no"])
    rows = rows.where((F.col("end_s") > F.col("seg_start")) & (F.col("start_s") < F.col("seg_end")))
    start, end = F.greatest("start_s", "seg_start") - F.col("seg_start"), F.least("end_s", "seg_end") - F.col("seg_start")
    return rows.select("video_id", "clip_no", "pos", start.alias("start_s"), end.alias("end_s"), "text").where("end_s > start_s")


def clip_files(cues: DataFrame, length: float, totals: DataFrame | None = None) -> DataFrame:
    """(video_id, file, vtt): a WebVTT text for every clip, also for those without a cue."""
    spine = clip_spine(cues, length, totals)
    line = F.concat(F.lit("\n"), from_seconds(F.col("start_s")), F.lit(" --> "), from_seconds(F.col("end_s")), F.lit("\n"), F.trim("text"), F.lit("\n"))
    held = cues_in_clips(cues, spine, length).groupBy("video_id", "clip_no").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("_x"))
    body = F.coalesce(F.array_join(F.transform("_x", lambda x: x["line"]), ""), F.lit(""))
    return spine.join(held, ["video_id", "clip_no"], "left").select("video_id", F.concat(F.lpad(F.col("clip_no").cast("string"), 4, "0"), F.lit(".vtt")).alias("file"), F.concat(F.lit("WEBVTT\n"), body).alias("vtt"))


def whole_vtt(cues: DataFrame) -> DataFrame:
    """(video_id, vtt): all cues of a video as one WebVTT text, by start."""
    line = F.concat(F.lit("\n"), from_seconds(F.col("start_s")), F.lit(" --> "), from_seconds(F.col("end_s")), F.lit("\n"), F.trim("text"), F.lit("\n"))
    held = cues.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start_s", "pos", line.alias("line")))).alias("_x"))
    return held.select("video_id", F.concat(F.lit("WEBVTT\n"), F.array_join(F.transform("_x", lambda x: x["line"]), "")).alias("vtt"))


def once_each(rows: DataFrame, order: Column | str = "pos") -> DataFrame:
    """The first row of each text of a video."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy("video_id", "text").orderBy(order))).where("_rn = 1").drop("_rn")


def _frames_of(start: float, end: float, rate: int) -> tuple[int, int]:
    """The first and the last frame whose time, frame / rate, lies from start to end; the first is after the last if there is none."""
    first, last = math.ceil(start * rate), math.floor(end * rate)
    while (first - 1) / rate >= start:  # a product may be off by a rounding
        first -= 1
    while first / rate < start:
        first += 1
    while (last + 1) / rate <= end:
        last += 1
    while last / rate > end:
        last -= 1
    return max(0, first), last


def running_text(frames: int, fps: float, cues: list[tuple[float, float, str]], length: int, most: int, words: bool) -> str:
    """The placeholders of a video's sampled frames, with what is said up to each.

    At every frame the cues whose time holds it (both ends count) are looked up. Without ``words`` the first whose text the running text doesn't
    hold is taken, if it wasn't before, and no other; with ``words`` all are, but only their words that neither the running nor the
    last caption holds. A sampled frame takes what has run up, until ``most`` words are out. Missing frames repeat the last.

    Only frames at which a cue begins or has ended, or which are sampled, change what is open; from each of them on, frames are looked at until one
    adds nothing, as then none does before the next. So the work follows the cues and the samples, not the frames.
    """
    step = max(1, int(frames / length))
    rate = max(1, int(fps))
    end = min(frames, step * (length - 1) + 1)
    opens, closes = defaultdict(list), defaultdict(list)
    for k, (s, e, _) in enumerate(cues):
        first, last = _frames_of(s, e, rate)
        if first <= last and first < end:
            opens[first].append(k)
            closes[last + 1].append(k)
    borders = sorted({f for f in {*opens, *closes, *range(0, end, step)} if f < end})
    out, run, before, seen, said, taken = [], "", "", set(), 0, 0
    open_: list[int] = []
    for frame, next_ in pairwise([*borders, end]):
        for k in closes[frame]:
            del open_[bisect.bisect_left(open_, k)]
        for k in opens[frame]:
            bisect.insort(open_, k)
        for at in range(frame, next_):
            was = len(run), len(seen)
            for k in open_:
                text = cues[k][2].replace("\n", " ")
                if words:
                    if text not in seen:
                        for w in text.split(" "):
                            if w not in run and w not in before:
                                run += w + " "
                    seen.add(text)
                elif text not in run:
                    if text not in seen:
                        run += text + " "
                    seen.add(text)
                    break
            same = was == (len(run), len(seen))
            if at % step == 0:
                out.append("<Img><ImageHere>")
                taken += 1
                if run and said < most:
                    out.append(f"<Cap>{run}")
                    said += len(run.split(" "))
                    before, run, same = run, "", False
            if same:
                break
    out.extend(["<Img><ImageHere>"] * (length - taken if taken else 0))
    return "".join(out)


def frame_captions(videos: DataFrame, cues: DataFrame, length: int = 45, most: int = 400, words: bool = False) -> DataFrame:
    """(video_id, prompt) of videos (video_id, frames, fps) and their cues; a video's fold is one task's, videos are dealt."""

    def fold(key: tuple, own: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({"video_id": [], "prompt": []})
        lines = [(float(r.start_s), float(r.end_s), r.text) for r in said.sort_values("pos").itertuples()]
        row = own.iloc[0]
        return pd.DataFrame({"video_id": [key[0]], "prompt": [running_text(int(row.frames), float(row.fps), lines, length, most, words)]})

    return videos.groupBy("video_id").cogroup(cues.groupBy("video_id")).applyInPandas(fold, "video_id string, prompt string")


def clip_memory(clips: DataFrame) -> DataFrame:
    """(pos, doc_key, text) of (clip_no, caption, subtitle): keys caption__00001, subtitle__00001; the number also counts clips without a text."""
    number = F.lpad(F.col("clip_no").cast("string"), 5, "0")
    both = F.array(*(F.struct(F.lit(i).alias("o"), F.concat(F.lit(f"{k}__"), number).alias("doc_key"), F.col(k).alias("text")) for i, k in enumerate(("caption", "subtitle"))))
    rows = clips.select("clip_no", F.explode(F.filter(both, lambda x: F.coalesce(x["text"], F.lit("")) != "")).alias("d"))
    return rows.select((F.col("clip_no").cast("long") * 2 + F.col("d.o")).alias("pos"), "d.doc_key", "d.text")


def related_context(ranked: DataFrame, memory: DataFrame, clips: int) -> DataFrame:
    """(query_id, context): of the first ``clips`` distinct clips of ranked keys (query_id, rank, doc_key), the summary and the subtitles, by rank.

    Of a clip's several documents of a kind the last counts. Keys without a clip are passed over.
    """
    clip = F.get(F.split("doc_key", "__"), 1)
    first = ranked.withColumn("clip", clip).where("clip IS NOT NULL").groupBy("query_id", "clip").agg(F.min("rank").alias("rank"))
    first = first.withColumn("_rn", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_rn") <= clips)
    kind = F.when(F.col("doc_key").contains("caption"), "caption").when(F.col("doc_key").contains("subtitle"), "subtitle")
    texts = memory.withColumn("clip", clip).withColumn("kind", kind).where("kind IS NOT NULL AND clip IS NOT NULL")
    texts = texts.groupBy("clip").agg(*(F.max_by(F.when(F.col("kind") == k, F.col("text")), F.when(F.col("kind") == k, F.col("pos"))).alias(k) for k in ("caption", "subtitle")))
    part = lambda label, c: F.coalesce(F.concat(F.lit(label), F.col(c)), F.lit(""))
    line = F.concat(part("Clip Summary: ", "caption"), F.lit(","), part("Clip Subtitles: ", "subtitle"), F.lit("\n"))
    held = first.join(texts, "clip", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_x"))
    return held.select("query_id", F.array_join(F.transform("_x", lambda x: x["line"]), "").alias("context"))
