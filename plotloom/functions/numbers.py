"""Column functions over times, positions, vectors and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_seconds(clock: Column) -> Column:
    """Whole seconds of HH:MM:SS; 0 for anything else."""
    part = F.split(clock, ":")
    h, m, s = (F.try_element_at(part, F.lit(k)).try_cast("int") for k in (1, 2, 3))
    return F.coalesce(F.when(F.size(part) == 3, h * 3600 + m * 60 + s), F.lit(0))


def from_seconds(seconds: Column) -> Column:
    """HH:MM:SS.mmm, milliseconds cut, not rounded; hours may pass 24; negative is 0."""
    ms = F.greatest(F.floor(seconds * 1000 + 1e-6), F.lit(0))  # 6.761 * 1000 is a little less than 6761
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    hours = F.floor(ms / 3600000)
    return F.concat(F.when(hours < 100, pad(hours, 2)).otherwise(hours.cast("string")), F.lit(":"), pad(F.floor(ms / 60000) % 60, 2), F.lit(":"), pad(F.floor(ms / 1000) % 60, 2), F.lit("."), pad(ms % 1000, 3))


def iso_seconds(duration: Column) -> Column:
    unit = lambda u: F.coalesce(F.regexp_extract(duration, rf"^PT.*?([0-9]+){u}", 1).try_cast("int"), F.lit(0))
    return unit("H") * 3600 + unit("M") * 60 + unit("S")


def linspace(n: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("int"))


def arange(n: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * n / k).cast("int"))


def segment_centres(last: Column, k: int) -> Column:
    """The middle of each of ``k`` equal segments of 0..last; offsets rounded half to even."""
    size = last.cast("double") / k
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(size / 2 + F.rint(size * i)).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes x1, y1, x2, y2 whose ends count."""
    side = lambda lo, hi: F.greatest(hi - lo + 1, F.lit(0))
    inner = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    area = lambda x: (x[2] - x[0] + 1) * (x[3] - x[1] + 1)
    return inner.cast("double") / (area(a) + area(b) - inner)


def grid_box(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    """A relative box on the grid 0 to 100, cut to whole numbers; the far corner adds the whole width to the near one."""
    at = lambda c: (c * 100).cast("int")
    return at(x), at(y), at(x) + at(w), at(y) + at(h)


def box_text(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """``{<x1><y1><x2><y2>}``; an error if a side leaves the grid of 0 to 100."""
    inside = lambda c: F.when((c >= 0) & (c <= 100), c).otherwise(F.raise_error(F.lit("box outside the grid")).cast("int"))
    return F.concat(F.lit("{"), *(F.concat(F.lit("<"), inside(c).cast("string"), F.lit(">")) for c in (x1, y1, x2, y2)), F.lit("}"))


def bounded_centres(k: int, fps: Column, last: Column, first: Column | int = 0, start: Column | float = -100000.0, end: Column | float = 100000.0) -> Column:
    """Like segment_centres, for the part from ``start`` to ``end`` seconds of frames ``first`` to ``last``; halves round to even."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    low = F.greatest(lit(first).cast("double"), F.rint(lit(start) * fps))
    size = (F.least(F.rint(lit(end) * fps), last.cast("double")) - low) / k
    cut = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: cut(low + size / 2 + F.rint(size * i)))


def every_kth(n: Column, most: int) -> Column:
    """Places 0, k, 2k, ... below n, at most ``most``; k is n / most, one at least."""
    step = F.greatest(F.lit(1), F.floor(n / most))
    return F.slice(F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)).cast("long"), step), lambda i: i < n), 1, most)


def padded(values: Column, n: int) -> Column:
    """The last value repeated until there are ``n``; an empty array stays empty."""
    return F.when(F.size(values) > 0, F.concat(values, F.array_repeat(F.element_at(values, -1), F.greatest(F.lit(n) - F.size(values), F.lit(0))))).otherwise(values)


def softmax(values: Column) -> Column:
    most = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v - most))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda s, x: s + x))


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.sqrt(dot(v, v)))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def pooled(tokens: Column, mask: Column, least: float = 1e-9) -> Column:
    """The mean of the token vectors that the mask counts, by place; the mask's sum is ``least`` at least."""
    total = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, x: s + x), F.lit(least))
    pairs = F.arrays_zip(tokens.alias("t"), mask.alias("m"))
    return F.transform(F.get(tokens, 0), lambda _, i: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.get(p["t"], i).cast("double") * p["m"]) / total)


def cosine_rate(step: Column, steps: Column, first: float, last: float) -> Column:
    return (first - last) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * step / steps)) + last


def warm_rate(step: Column, steps: Column, first: float, most: float) -> Column:
    return F.least(F.lit(most), F.lit(first) + (most - first) * step / F.greatest(steps, F.lit(1)))


def step_rate(epoch: Column, first: float, last: float, decay: float) -> Column:
    return F.greatest(F.lit(last), first * F.pow(F.lit(decay), epoch))
