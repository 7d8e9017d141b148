"""Running totals, numbers and even parts in an order, over whole tables or groups of any size: a scan in two levels."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed(rows: DataFrame, order: Sequence[str], buckets: int = 256, sample: int = 20_000) -> DataFrame:
    """Adds _bucket: rising with ``order``, so that each bucket holds about as many rows.

    Borders come from about ``sample`` rows, picked by a hash of their keys; ties in all keys share a bucket, and so do up to ``sample`` rows. The rows are counted
    and sampled first, so rows that are dear to make should be stored before. A row finds its bucket among coarse borders, then among the fine ones there.
    """
    n = rows.count()
    if n <= sample:
        return rows.withColumn("_bucket", F.lit(0))
    few = rows.where(F.pmod(F.xxhash64(*order), F.lit(max(1, -(-n // sample)))) == 0).select(*order).distinct().orderBy(*order).limit(2 * sample).collect()
    places = sorted({len(few) * k // buckets for k in range(1, buckets)} - {0})
    kinds = [rows.schema[c].dataType for c in order]
    borders = [F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(few[p], kinds, order, strict=True))) for p in places]
    if not borders:
        return rows.withColumn("_bucket", F.lit(0))
    key = F.struct(*order)
    wide = math.isqrt(len(borders)) + 1
    fine = F.array(*borders)
    coarse = F.array(*borders[wide - 1 :: wide]) if len(borders) >= wide else F.array().cast(rows.select(F.array(key)).schema[0].dataType)
    below = lambda all_: F.size(F.filter(all_, lambda b: b <= key))
    return rows.withColumn("_coarse", below(coarse)).withColumn("_bucket", F.col("_coarse") * wide + below(F.slice(fine, F.col("_coarse") * wide + 1, wide))).drop("_coarse")


def running(rows: DataFrame, order: Sequence[str], sums: Mapping[str, Column] | None = None, place: str | None = None, size: str | None = None, by: Sequence[str] = (), buckets: int = 256, sample: int = 20_000) -> DataFrame:
    """Adds for each name of ``sums`` the total of its column up to and with the row, in ``order``; ``place``, the number of rows before; ``size``, that of all.

    With ``by`` in each group, null being a group. Rows are dealt by bucket of the order (see bucketed) and group, and summed there; the totals of the
    buckets, at most ``buckets`` a group, are summed over the buckets before and joined back. So neither the table nor a large group is ever one task's,
    and small groups share buckets. ``order`` should end with a key, as ties in all of it share a bucket. A null adds nothing.
    """
    sums = dict(sums or {})
    keys = [*by, *(c for c in order if c not in by)]
    laid = bucketed(rows.withColumns({f"_of_{c}": v for c, v in sums.items()}), keys, buckets, sample).withColumn("_group", F.struct(F.lit(0).alias("_"), *by))
    inner = Window.partitionBy("_bucket", "_group").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy("_bucket", "_group").agg(F.count("*").alias("_rows"), *(F.sum(f"_of_{c}").alias(f"_sum_{c}") for c in sums))
    before = totals.select(
        "_bucket", "_group", F.coalesce(F.sum("_rows").over(outer), F.lit(0)).alias("_rows_before"), F.sum("_rows").over(Window.partitionBy("_group")).alias("_rows_all"),
        *(F.sum(f"_sum_{c}").over(outer).alias(f"_before_{c}") for c in sums),
    )
    out = laid.withColumns({f"_in_{c}": F.sum(f"_of_{c}").over(inner) for c in sums} | ({"_row": F.row_number().over(Window.partitionBy("_bucket", "_group").orderBy(*order)) - 1} if place else {}))
    before = before.withColumnRenamed("_bucket", "_b").withColumnRenamed("_group", "_g")
    out = out.join(before if by else F.broadcast(before), (F.col("_bucket") == F.col("_b")) & (F.col("_group") == F.col("_g")))  # without groups, at most ``buckets`` rows
    both = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    found = {c: both(F.col(f"_before_{c}"), F.col(f"_in_{c}")) for c in sums} | ({place: F.col("_rows_before") + F.col("_row")} if place else {}) | ({size: F.col("_rows_all")} if size else {})
    return out.withColumns(found).select(*(c for c in rows.columns if c not in found), *found)


def even_parts(rows: DataFrame, parts: int, order: Sequence[str], name: str = "part", by: Sequence[str] = ()) -> DataFrame:
    """Adds ``name``, 1 to ``parts``: the rows of each group in ``order``, cut into parts whose sizes differ by one at most, larger ones first."""
    at, n = F.col("_at"), F.col("_of")
    small, more = F.floor(n / parts), n % parts
    part = F.when(at < more * (small + 1), F.floor(at / (small + 1))).otherwise(more + F.floor((at - more * (small + 1)) / F.greatest(small, F.lit(1)))) + 1
    return running(rows, order, place="_at", size="_of", by=by).withColumn(name, part.cast("int")).drop("_at", "_of")
