"""Mixing sources to target weights: fixed blocks of words, drawn shard by shard through index permutations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotloom.llm.common import WORD, durable, give_back, hex_bucket, mix64, prefix_sums, small_batches, text_slices, word_bounds
from plotloom.operators.prefix import running

#: Sources whose shares are drawn together. A shard first draws counts for groups of so many, then for the sources of each group.
GROUP = 4096
#: Tables of a row a source, or an array a group of sources, are broadcast up to so many sources, and merged beyond.
BROADCAST = 20_000
#: A source has at least so many blocks, as far as its words go; its blocks are shorter for that.
LEAST_BLOCKS = 256


def catalogue(rows: DataFrame, share: float, weights: Sequence[float], cap: int, block: int) -> tuple[DataFrame, int]:
    """A durable table of the sources, with their number.

    src numbers the sources by code point, null last; weights repeat in that order. Targets share ``share`` of all sizes by weight; a target stops at
    cap * size and its excess is shared again among the rest, until none is above: the level that all others reach is raised
    round by round. blocks of ``words`` words each (the last may be shorter) make a source; slots is the number of them that its target is worth.
    """
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    found = running(durable(found), ["_null", "source"], place="src").drop("_null").withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("src") % len(weights) + 1).cast("int")))
    found = durable(found.withColumn("most", F.col("source_size") * float(cap)))
    sizes = found.agg(F.count("*"), F.sum("source_size")).first()
    wanted, level, full = min(float(share), float(cap)) * (sizes[1] or 0), 0.0, -1
    while True:
        stopped = (F.col("most") <= level * F.col("weight")) | (F.col("source_size") == 0)
        r = found.agg(F.count_if(stopped), F.sum(F.when(stopped, F.col("most"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        if r[0] == full or not r[2]:
            break
        full, level = r[0], (wanted - (r[1] or 0.0)) / r[2]
    target = F.when(stopped, F.col("most")).otherwise(F.least(F.col("most"), level * F.col("weight")))
    words = F.greatest(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), F.floor(F.col("source_size") / LEAST_BLOCKS)))
    out = found.withColumn("target", target).withColumn("words", words).withColumn("blocks", F.ceil(F.col("source_size") / F.col("words")))
    out = out.withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    return durable(out.select("source", "src", "source_size", "target", "words", "blocks", "slots")), sizes[0]


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1: a four-round Feistel network on the next even power of two, walked until it falls inside."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mix64(right + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def draw_counts(open_: DataFrame, shares: DataFrame, sources: int, seed: int, turn: int) -> DataFrame:
    """(shard, src, n): each shard draws its open slots (shard, n) from the sources, multinomially by their shares (src, share).

    Seeded by shard and turn, so that a shard's draw needs no other's. A shard draws counts for groups of ``GROUP`` sources and then
    splits each, so it holds a number for each group, and a group's shares, at a time.
    """
    grouped = shares.where("share > 0").groupBy(F.floor(F.col("src") / GROUP).alias("grp")).agg(F.array_sort(F.collect_list(F.struct("src", "share"))).alias("own"), F.sum("share").alias("total"))
    totals = sorted((r.grp, r.total) for r in grouped.select("grp", "total").collect())  # a row for each GROUP sources
    numbers, p = np.array([g for g, _ in totals], np.int64), np.array([t for _, t in totals])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, n in zip(b.column("shard").to_pylist(), b.column("n").to_pylist(), strict=True):
                got = np.random.default_rng([seed, turn, shard]).multinomial(n, p / p.sum())
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_pydict({"shard": np.full(len(at), shard), "grp": numbers[at], "n": got[at]})

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (shard, grp, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("shard", "grp", "n")), strict=True)):
                own = b.column("own")[i].values
                src, q = own.field("src").to_numpy(), own.field("share").to_numpy()
                got = np.random.default_rng([seed, turn, shard, grp]).multinomial(n, q / q.sum())
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_pydict({"shard": np.full(len(at), shard), "src": src[at], "n": got[at]})
        give_back()

    first = open_.mapInArrow(between, "shard long, grp long, n long")
    lists = grouped.select("grp", "own")
    return first.join(F.broadcast(lists) if sources <= BROADCAST else lists.hint("merge"), "grp").mapInArrow(within, "shard long, src long, n long")


def draw_slots(sources: DataFrame, number: int, shard_slots: int, cap: int, seed: int) -> DataFrame:
    """(src, blocks, shard, first, n): the slots of each output shard, as runs of the source's slots, numbered from 0 through all shards.

    Each shard of ``shard_slots`` slots draws how many of them each source gets, multinomially by the sources' expected slots. Where the shards together
    draw more of a source than one above its expected number, or than cap * blocks, the last ones give theirs back and draw these again, by the room that
    is left, until none is above. So a source misses its target by a few slots at any size, and no block is taken more than ``cap`` times.
    """
    spark = sources.sparkSession
    total = int((sources.agg(F.sum("slots")).first()[0] or 0.0) + 1e-6)
    shards = -(-total // shard_slots)
    room = F.least(F.col("blocks") * cap, F.ceil(F.col("slots") - 1e-6) + 1)
    open_ = spark.range(shards).select(F.col("id").alias("shard"), F.least(F.lit(shard_slots).cast("long"), F.lit(total) - F.col("id") * shard_slots).alias("n"))
    state = sources.select("src", "blocks", "slots", room.alias("most"), F.lit(0).cast("long").alias("taken"))
    out, turn, left = None, 0, total
    while left:
        shares = state.select("src", (F.col("slots") if turn == 0 else (F.col("most") - F.col("taken")).cast("double")).alias("share"))
        drawn = prefix_sums(draw_counts(open_, shares, number, seed, turn), "src", ["shard"], "n", "before", F.floor(F.col("shard") / 256))
        drawn = drawn.join(F.broadcast(state) if number <= BROADCAST else state.hint("merge"), "src")
        kept = F.greatest(F.lit(0), F.least(F.col("n"), F.col("most") - F.col("taken") - F.col("before")))
        drawn = durable(drawn.select("src", "blocks", "shard", (F.col("taken") + F.col("before")).alias("first"), kept.alias("n"), (F.col("n") - kept).alias("back")))
        found = drawn.where("n > 0").drop("back")
        out = found if out is None else out.unionByName(found)
        open_ = drawn.groupBy("shard").agg(F.sum("back").alias("n")).where("n > 0")
        more = drawn.groupBy("src").agg(F.sum("n").alias("_more"))
        left, turn = drawn.agg(F.sum("back")).first()[0], turn + 1
        if left:
            state = durable(state.join(more, "src", "left").withColumn("taken", F.col("taken") + F.coalesce("_more", F.lit(0))).drop("_more"))
            open_ = durable(open_)
    return spark.createDataFrame([], "src long, blocks long, shard long, first long, n long") if out is None else out


def slots(drawn: DataFrame, seed: int, run: int = 1 << 16) -> DataFrame:
    """(src, block, shard): the block of each drawn slot. Slot k of a source holds block permutation(k mod blocks), a new permutation each time around."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for src, blocks, shard, first, n in zip(*(b.column(c).to_pylist() for c in ("src", "blocks", "shard", "first", "n")), strict=True):
                for low in range(first, first + n, run):
                    k = np.arange(low, min(low + run, first + n))
                    out = np.empty(len(k), np.int64)
                    for turn in np.unique(k // blocks):
                        at = k // blocks == turn
                        out[at] = permute(k[at] % blocks, blocks, seed * 1_000_003 + src * 101 + int(turn))
                    yield pa.RecordBatch.from_pydict({"src": np.full(len(k), src), "block": out, "shard": np.full(len(k), shard)})
        give_back()

    return drawn.mapInArrow(place, "src long, block long, shard long")


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("size", F.regexp_count(text, F.lit(WORD)).cast("long")).withColumn("source", F.col("source").cast("string"))


def _laid_out(rows: DataFrame, order: Sequence[str], share, weights, cap, block, seed, shard_slots, draw_seed) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(sized rows with src, words, place and first word; how often each block is taken; catalogue; number of sources)."""
    if cap != int(cap) or cap < 1:
        raise ValueError("cap must be a whole number, as blocks are taken whole")
    sources, number = catalogue(rows.select("source", "size"), share, weights, int(cap), block)
    listed = sources.select(F.col("source").alias("_name"), "src", "words")
    rows = rows.join(F.broadcast(listed) if number <= BROADCAST else listed.hint("merge"), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    rows = prefix_sums(rows, "src", order, "size", "first", hex_bucket("doc_id", "size"), rank="place")
    drawn = draw_slots(sources, number, shard_slots, int(cap), seed if draw_seed is None else draw_seed)
    uses = slots(drawn, seed).groupBy("src", "block").agg(F.count("*").alias("uses"))
    return rows, uses, sources, number


def _segments(rows: DataFrame, uses: DataFrame, *keep: str) -> DataFrame:
    """Each row's blocks with how often the mix takes them.

    ``uses`` has a row for each taken block, but Spark may expect a few kilobytes, as it stems from Python: without the hint it may be broadcast.
    """
    words = F.col("words")
    ends = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("first") / words), F.floor((F.col("first") + F.col("size") - 1) / words))).otherwise(F.array(F.lit(-1).cast("long")))
    cut = rows.select(*keep, "src", "words", "place", "first", "size", F.explode(ends).alias("block"))
    low = F.greatest(F.col("first"), F.col("block") * words)
    high = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * words)
    return cut.join(uses.hint("merge"), ["src", "block"], "left").withColumn("low", low - F.col("first")).withColumn("high", high - F.col("first")).withColumn("uses", F.coalesce("uses", F.lit(0).cast("long")))


def mix_sources(docs: DataFrame, share: float = 1.5, weights: Sequence[float] = (3, 1, 2), cap: int = 2, block: int = 64, shard_slots: int = 4096, seed: int = 7, draw_seed: int | None = None) -> DataFrame:
    """One row per document of (doc_id, text, source): doc_id, size, source_size, target and taken.

    Words of a source's documents, laid end to end in pseudorandom order, make blocks of ``block`` words, shorter ones in a source of few
    words. The mix takes ``share`` of all words by ``weights``; see catalogue, draw_slots and slots. taken counts the words of the
    document in the drawn blocks, repeats included, and never exceeds ``cap`` times its size. A source's taken words miss its target by a few
    blocks at most. ``draw_seed``, ``seed`` where it isn't given, seeds the shards' draws alone, not the permutations.

    A null or empty text has size 0 and takes nothing; null is a source of its own, the last; repeated rows and doc_ids
    are separate rows; other columns are not read; an empty table gives an empty result. The same input and
    seeds give the same result. Texts are read once, into a durable table of sizes; only sizes are shuffled, and a source that holds most rows is dealt over 256
    buckets. There may be any number of sources: their table is broadcast up to ``BROADCAST`` rows and merged beyond.
    """
    sized = durable(_sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")).drop("text"))
    rows, uses, sources, number = _laid_out(sized, ["doc_id", "size"], share, weights, cap, block, seed, shard_slots, draw_seed)
    overlap = F.when(F.col("block") >= 0, (F.col("high") - F.col("low")) * F.col("uses")).otherwise(0)
    taken = _segments(rows, uses, "doc_id").groupBy("src", "place", "doc_id", "size").agg(F.sum(overlap).alias("taken"))
    listed = sources.select("src", "source_size", "target")
    return taken.join(F.broadcast(listed) if number <= BROADCAST else listed.hint("merge"), "src").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, share: float = 1.5, weights: Sequence[float] = (3, 1, 2), cap: int = 2, block: int = 64, shard_slots: int = 4096, seed: int = 7) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each maximal run of taken words of a document and turn.

    A document whose blocks are all taken comes back whole; one taken twice comes back twice; at the border of a
    block that isn't taken the text is cut between words. A null or empty text, or one without words, is kept as it is, once. n_chars, where
    there is such a column, counts the code points of the new text. Texts are cut in slices of about half a megabyte.

    Rows with equal doc_ids (or none) and sizes are ordered by the MD5 of the whole row, so that the same rows give the same texts
    however they are partitioned; rows equal in every column are interchangeable. A null source is a source of its own. An empty
    table stays empty; extra columns of any name are carried along.
    """
    columns = docs.columns
    whole_row = F.struct(*(F.col(f"`{c}`") for c in columns))
    kept = docs.select(whole_row.alias("_doc"), F.md5(F.to_json(whole_row)).alias("_hash"), F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    rows, uses, _, _ = _laid_out(_sized(kept), ["doc_id", "size", "_hash"], share, weights, cap, block, seed, shard_slots, None)
    parts = _segments(rows.select("src", "words", "place", "first", "size"), uses).where("block >= 0").groupBy("src", "place").agg(F.array_sort(F.collect_list(F.struct("low", "high", "uses"))).alias("parts"))
    whole = rows.select("src", "place", "_doc").join(parts, ["src", "place"], "left").select("_doc.*", F.col("parts.low").alias("_low"), F.col("parts.high").alias("_high"), F.col("parts.uses").alias("_uses"))
    others = [c for c in columns if c != "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch.column("text")):
                part = batch.slice(at, len(offsets) - 1)
                lows, highs, turns = (part.column(c).to_pylist() for c in ("_low", "_high", "_uses"))
                bodies, kind = part.column("text"), part.column("text").type
                starts, ends, of = word_bounds(data, offsets)
                words = np.searchsorted(of, np.arange(len(lows) + 1))
                row, text = [], []
                for i, (low_, high_, turns_) in enumerate(zip(lows, highs, turns, strict=True)):
                    if not low_:
                        row.append(i), text.append(bodies[i].as_py())
                        continue
                    first, n = words[i], words[i + 1] - words[i]
                    for turn in range(max(turns_)):
                        runs: list[list[int]] = []
                        for low, high, uses_ in zip(low_, high_, turns_, strict=True):
                            if uses_ > turn:
                                if runs and runs[-1][1] == low:
                                    runs[-1][1] = high
                                else:
                                    runs.append([low, high])
                        for low, high in runs:
                            begin, end = (offsets[i], offsets[i + 1]) if low == 0 and high == n else (starts[first + low], ends[first + high - 1])
                            row.append(i), text.append(data[begin:end].tobytes().decode())
                rest = part.select(others).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(text, kind) if c == "text" else rest.column(c) for c in columns], columns)
        give_back()

    small_batches(docs.sparkSession)
    out = whole.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
