"""Jump consistent hashing: rows to shards by a stable key, without a table of ring positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotloom.llm.common import hex_bucket, prefix_sums

#: The multiplier of the 64-bit linear congruential generator of the published algorithm.
_MULTIPLIER = 2862933555777941757
#: Steps of the first fold, and copies of a row that are numbered at once.
_STEPS, _RUN = 64, 65536
_LIMBS = [_MULTIPLIER >> 16 * k & 0xFFFF for k in range(4)]


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2**64, on halves of 32 bits, so that no product leaves a signed 64-bit number."""
    c0, c1, c2, c3 = (F.lit(x).cast("long") for x in _LIMBS)
    sixteen = F.lit(0xFFFF).cast("long")
    word = F.lit(0xFFFFFFFF).cast("long")
    second = low * c1
    below = low * c0 + F.shiftleft(second.bitwiseAND(sixteen), 16) + F.lit(1).cast("long")
    above = (
        F.shiftright(below, 32) + F.shiftright(second, 16) + low * c2 + F.shiftleft((low * c3).bitwiseAND(sixteen), 16)
        + high * c0 + F.shiftleft((high * c1).bitwiseAND(sixteen), 16)
    )
    return above.bitwiseAND(word), below.bitwiseAND(word)


def _jumped(key: Column, shards: int) -> Column:
    """The state (at, next) of a 64-bit key: its shard, and the number of shards up to which it stays there."""
    word = F.lit(0xFFFFFFFF).cast("long")
    key = key.cast("long")
    start = F.struct(
        F.shiftright(key, 32).bitwiseAND(word).alias("high"), key.bitwiseAND(word).alias("low"),
        F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"),
    )

    def jump(state: Column, _: Column) -> Column:
        high, low = _step(state["high"], state["low"])
        ahead = ((state["next"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(high.alias("high"), low.alias("low"), state["next"].alias("at"), ahead.alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    def fold(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, jump)

    few = fold(start, min(int(shards), _STEPS))
    return few if shards <= _STEPS else F.transform(F.array(few), lambda s: F.when(s["next"] < shards, fold(s, int(shards))).otherwise(s))[0]


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a 64-bit key.

    Going from n to n + 1 shards moves a key only if it moves into shard n, which holds for one key in n + 1.
    A step jumps ahead by at least one shard, so ``shards`` steps always suffice; mostly about log(shards) do, so of many shards
    only the keys that aren't done after ``_STEPS`` steps go on. The steps run as one fold.
    """
    return _jumped(key, shards)["at"].cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, size (UTF-8 bytes + 1), text_crc32, law, shard, slot and grown_shard.

    Law ``key``: key and shard count alone decide; grown_shard is the shard with one shard more and differs from
    shard only where it is the new one. slot numbers a shard's rows without gaps from 0, by MD5 bucket of key and
    checksum, then key, checksum and size.

    A null key counts as key 0 (and stays null in the result). A null text has no bytes: size 1, checksum 0. Equal keys
    share a shard whatever their texts; repeated rows each get a slot. Columns other than key and text are
    not read, so their names can't clash. An empty table gives an empty result.

    Texts are read once. Rows equal in key, size and checksum are counted before any shuffle and take neighbouring slots, so that
    a row's copies, however many, meet as one number. The counts are dealt by shard and one of 256 buckets; a shard's rows never
    meet in one task.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_rows"))
    placed = counted.withColumn("_state", _jumped(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), shards)).select(
        "doc_id", "size", "text_crc32", "_rows", F.col("_state.at").cast("int").alias("shard"),
        F.when(F.col("_state.next") == shards, shards).otherwise(F.col("_state.at")).cast("int").alias("grown_shard"),
    )
    ranked = prefix_sums(placed, "shard", ["doc_id", "text_crc32", "size"], "_rows", "_first", hex_bucket("doc_id", "text_crc32"))
    spread = ranked.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rows") - 1) / _RUN)))).withColumn(
        "_place", F.explode(F.sequence(F.col("_part") * _RUN, F.least(F.col("_part") * _RUN + _RUN, "_rows") - 1))
    )
    return spread.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_place")).alias("slot"), "grown_shard")
