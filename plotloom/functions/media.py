"""Column functions over captions, instructions, boxes, strokes, conversations and addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotloom.functions.text import strip

# The tags that a model reads, and the mark between turns.
IMAGE, TURN = "<Img><ImageHere></Img>", "!@#"


def drawn_from(pool: Sequence[str], *key: Column) -> Column:
    """One text of the pool by the MD5 of the key."""
    place = F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in key))), 1, 8), 16, 10).cast("long") % len(pool)
    return F.get(F.array(*map(F.lit, pool)), place.cast("int"))


def instruction(pool: Sequence[str], key: Column, value: Column | None = None, around: str = IMAGE + " {} ") -> Column:
    """A template of the pool with ``value`` in its {}, inside ``around``."""
    text = drawn_from(pool, key)
    filled = text if value is None else F.replace(text, F.lit("{}"), F.coalesce(value, F.lit("")))
    head, _, tail = around.partition("{}")
    return F.concat(F.lit(head), filled, F.lit(tail))


def rationale_parts(text: Column) -> tuple[Column, Column]:
    """(what stands before the first ``\\nAnswer:``, what stands after the last); without one, both are the whole."""
    parts = F.split(text, "\nAnswer:")
    return F.get(parts, 0), F.element_at(parts, -1)


def constrained(instruction_: Column, constraint: Column) -> Column:
    return F.when(constraint.isNull(), instruction_).otherwise(F.concat(instruction_, F.lit(" "), constraint))


def video_caption(name: Column) -> Column:
    """What stands after the last '-', and there after the last ':'."""
    return F.element_at(F.split(F.element_at(F.split(name, "-"), -1), ":"), -1)


def numbered_choice_prompt(question: Column, answers: Sequence[Column]) -> Column:
    options = [F.concat(F.lit(f"option {i}: "), a, F.lit(" \n\n")) for i, a in enumerate(answers)]
    return F.concat(
        question, F.lit(" \n\n As you watched in this video Choose ONE suitable answer from these mutiple choices \n\n"), *options,
        F.lit("\n Your output should be THE NUMBER OF THE CORRECT ANSWER FROM THE CHOICES FROM 0 TO 4 INCLUSIVE"),
    )


def turns_folded(values: Column) -> tuple[Column, Column]:
    """(questions, answers) of turns that alternate, each joined by the turn mark; the first question loses its image tag and line feeds."""
    first = F.concat(F.lit(IMAGE + " "), strip(F.replace(F.replace(F.get(values, 0), F.lit("<image>"), F.lit("")), F.lit("\n"), F.lit(""))), F.lit(" "))
    side = lambda k: F.filter(values, lambda v, i: (i % 2 == k) & (i > 0))
    return F.array_join(F.concat(F.array(first), side(0)), TURN), F.array_join(side(1), TURN)


def conversation_text(system: Column, turns: Column, two: bool = False, seps: tuple[str, str] = ("<s>", "</s>")) -> Column:
    """The prompt of (role, message) turns: role and message one after another; with ``two`` a separator follows each message, the two in turn."""
    mark = lambda i: F.when(i % 2 == 0, seps[0]).otherwise(seps[1]) if two else F.lit("")
    said = F.transform(turns, lambda t, i: F.when(F.coalesce(t["message"], F.lit("")) != "", F.concat(t["role"], t["message"], mark(i))).otherwise(t["role"]))
    return F.concat(system, F.lit("<s>"), F.array_join(said, ""))


def grounded_caption(caption: Column, phrases: Column, boxes: Column) -> Column:
    """The caption with its last phrase grounded: ``<p>phrase</p>`` and all its boxes so far, with ``<delim>`` between them.

    Only the last phrase is put in, everywhere it stands.
    """
    last = F.element_at(phrases, -1)
    pairs = F.filter(F.arrays_zip(phrases.alias("p"), boxes.alias("b")), lambda x: x["p"] == last)
    text = F.concat(F.lit("<p>"), last, F.lit("</p> "), F.array_join(F.transform(pairs, lambda x: x["b"]), "<delim>"))
    return F.when(F.size(phrases) > 0, F.replace(caption, last, text)).otherwise(caption)


def object_list(objects: Column, boxes: Column, key: Column) -> Column:
    """``{object,box}, {object,box}`` in a drawn order, without quotes and square brackets."""
    rows = F.transform(F.arrays_zip(objects.alias("o"), boxes.alias("b")), lambda x, i: F.struct(F.md5(F.concat_ws("|", key.cast("string"), i.cast("string"))).alias("h"), F.concat(F.lit("{"), x["o"], F.lit(","), F.trim(x["b"]), F.lit("}")).alias("t")))
    return F.translate(F.array_join(F.transform(F.array_sort(rows), lambda r: r["t"]), ", "), "'[]", "")


def valid_words(boxes: Column) -> Column:
    """The recognised words whose relative box (top_left_x, top_left_y, width, height) lies inside the image."""
    at = lambda w, c: w["bounding_box"][c]
    return F.filter(boxes, lambda w: (at(w, "width") + at(w, "top_left_x") <= 1) & (at(w, "height") + at(w, "top_left_y") <= 1) & (at(w, "top_left_x") >= 0) & (at(w, "top_left_y") >= 0))


def stroke_text(strokes: Column, tag: Column, opaque: bool = False) -> Column:
    """``[tag]0(a,b,...);1(...)`` of arrays of 13 numbers from 0 to 1, scaled to 255; ``opaque`` leaves the two transparencies out."""
    kept = lambda s: F.filter(s, lambda _, i: ~i.isin(8, 9)) if opaque else s
    one = lambda s, i: F.concat(i.cast("string"), F.lit("("), F.array_join(F.transform(kept(s), lambda v: (v * 255).cast("int").cast("string")), ","), F.lit(")"))
    return F.concat(tag, F.array_join(F.transform(strokes, one), ";"))


def point_stroke(stroke: Column) -> Column:
    """``(x,y,w,h,degrees,r,g,b)`` of a stroke whose angle is in half turns and colours from 0 to 1."""
    scale = lambda v, i: (v * F.when(i == 4, 180).when(i > 4, 255).otherwise(1)).cast("int").cast("string")
    return F.concat(F.lit("("), F.array_join(F.transform(stroke, scale), ","), F.lit(")"))


def sampled_region(u: Column, v: Column, others: Column) -> Column:
    """Where a mask point is drawn, from two numbers in [0, 1): object, background, other object or contour."""
    return F.when(u < 0.4, "object").when(v < 0.1, "background").when(others & (v < 0.6), "other").otherwise("contour")


def youtube_id(url: Column) -> Column:
    """What stands after the last ``watch?v=`` and before the next '&'."""
    return F.substring_index(F.substring_index(url, "https://www.youtube.com/watch?v=", -1), "&", 1)


def is_youtube(url: Column) -> Column:
    return url.rlike(r"^(https?://)?(www\.)?(youtube\.com/watch\?v=|youtu\.be/)")


def is_web(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://")


def has_scheme(url: Column) -> Column:
    return url.rlike(r"^\w+://")


def drive_id(url: Column) -> Column:
    """The file of a Google Drive or Docs address, or null."""
    return F.nullif(F.regexp_extract(url, r"^\w+://(?:drive|docs)\.google\.com[^/]*/file/d/([^/?#]*)", 1), F.lit(""))


def truth_of(text: Column) -> Column:
    """yes, true, t, y, 1 and no, false, f, n, 0 in any case; an error for anything else."""
    low = F.lower(text)
    return F.when(low.isin("yes", "true", "t", "y", "1"), True).when(low.isin("no", "false", "f", "n", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), text)).cast("boolean"))


def megabytes(size: Column) -> Column:
    return size / float(1024**2)


def page_file(page: Column) -> Column:
    return F.concat(F.lit("slide_"), page.cast("string"), F.lit("_1024.jpg"))


def image_file(number: Column) -> Column:
    """Twelve digits and .jpg."""
    text = number.cast("string")
    return F.concat(F.when(F.length(text) < 12, F.lpad(text, 12, "0")).otherwise(text), F.lit(".jpg"))


def has_words(text: Column, least: int = 60) -> Column:
    return F.size(F.split(text, " ")) >= least


def last_words(text: Column, n: int) -> Column:
    words = F.split(text, " ")
    return F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n), " ")
