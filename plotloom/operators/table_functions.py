"""Row generators that SQL can call: cues to the subtitle files of clips, pages to their paragraphs."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from plotloom.functions.text import BLANK

_CUE = {"video_id": StringType, "pos": None, "start_s": None, "end_s": None, "text": StringType}


def clock(seconds: float) -> str:
    """HH:MM:SS.mmm as ``numbers.from_seconds`` gives it."""
    ms = max(0, math.floor(seconds * 1000 + 1e-6))
    return f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


@udtf
class Clips:
    """``clips(TABLE(cues) PARTITION BY (video_id), length)``: a row for each clip of a video, with its WebVTT text; see ``subtitles.clip_files``.

    cues has video_id, pos, start_s, end_s and text, in any order and beside other columns; a partition is a video's.
    """

    @staticmethod
    def analyze(cues: AnalyzeArgument, length: AnalyzeArgument) -> AnalyzeResult:
        if not cues.isTable:
            raise ValueError("clips takes TABLE(...) PARTITION BY video_id")
        have = {f.name: f.dataType for f in cues.dataType}
        for name, kind in _CUE.items():
            if name not in have or (kind and not isinstance(have[name], kind)):
                raise ValueError(f"clips needs a column {name}")
        if length.value is None or float(length.value) <= 0:
            raise ValueError("the length of a clip must be above 0")
        return AnalyzeResult(StructType().add("video_id", StringType()).add("clip_no", LongType()).add("file", StringType()).add("vtt", StringType()))

    def __init__(self):
        self.rows: list[tuple] = []
        self.length = 0.0

    def eval(self, cues: Row, length) -> None:
        self.length = float(length)
        self.rows.append((cues["video_id"], cues["pos"], float(cues["start_s"]), float(cues["end_s"]), cues["text"] or ""))

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        video, size = self.rows[0][0], self.length
        total = max(r[3] for r in self.rows)
        lines: dict[int, list[str]] = defaultdict(list)
        for _, _, start, end, text in sorted(self.rows, key=lambda r: r[1]):
            for i in range(math.floor(start / size), max(math.floor(start / size), math.floor(end / size)) + 1):
                low, high = i * size, min((i + 1) * size, total)
                if 0 <= low < total and end > low and start < high and min(end, high) > max(start, low):
                    lines[i].append(f"\n{clock(max(start, low) - low)} --> {clock(min(end, high) - low)}\n{text.strip(' ')}\n")
        for i in range(math.ceil(total / size)):
            yield video, i + 1, f"{i + 1:04d}.vtt", "WEBVTT\n" + "".join(lines[i])


def register(spark: SparkSession) -> None:
    """Makes ``clips`` and ``html_rows(html)`` (pos, paragraph) known to the session's SQL. The second is SQL itself, so it runs without Python."""
    spark.udtf.register("clips", Clips)
    spark.sql(rf"""
CREATE OR REPLACE TEMPORARY FUNCTION html_rows(html STRING) RETURNS TABLE(pos INT, paragraph STRING) RETURN
SELECT t.pos, t.p FROM posexplode(filter(transform(regexp_extract_all(html, r'(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1), b -> trim(regexp_replace(regexp_replace(b, r'(?s)<[^>]*>', ' '), r'[{BLANK}]+', ' '))), b -> b <> '')) AS t(pos, p)
""")
