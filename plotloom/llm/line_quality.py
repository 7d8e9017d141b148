"""Quality rules: words, symbols and repetition in a text, and lines that many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotloom.llm.common import byte_hashes, durable, give_back, mix64, small_batches, text_slices, unique_words, word_bounds

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("host", pa.string()), *((c, pa.int64()) for c in _COUNTS), ("text_hash", pa.int64()), ("line_hashes", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64()))]
)


def _codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number for each pair of non-negative numbers, equal only for equal pairs."""
    if (int(first.max(initial=0)) + 1) * (int(second.max(initial=0)) + 1) > 1 << 62:
        first = np.unique(first, return_inverse=True)[1]
    return first * (int(second.max(initial=0)) + 1) + second


def _repeats(values: np.ndarray) -> np.ndarray:
    """True where a value occurs twice or more."""
    order = np.argsort(values)
    same = values[order[1:]] == values[order[:-1]]
    out = np.zeros(len(values), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """The base counts of each row, and the row's distinct normalised lines with the words they hold in all.

    A normalised line is its words, A-Z lower-cased, as a sequence; only a 64-bit hash of it is kept, made of XXH3 hashes of the words and
    their places. The base counts compare words and lines themselves, not hashes.
    """
    n = len(offsets) - 1
    starts, ends, row = word_bounds(data, offsets)
    per_row = lambda at, weights=None: np.bincount(at, weights, n).astype(np.int64)
    zero = np.zeros(n, np.int64)
    if not len(starts):
        return {c: zero for c in _COUNTS}, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out = {
        "n_words": per_row(row), "word_chars": per_row(row, points[ends] - points[starts]),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
    }
    code, distinct = unique_words(data, starts, ends)
    covered = np.zeros(len(code), bool)
    if len(code) >= 3:
        whole = np.flatnonzero(row[2:] == row[:-2])
        words = code.astype(np.int64)
        again = whole[_repeats(_codes(_codes(_codes(words[whole], words[whole + 1]), words[whole + 2]), row[whole]))]
        for k in range(3):
            covered[again + k] = True
    out["n_repeat_words"] = per_row(row[covered])

    feeds = np.flatnonzero(data == 0x0A)
    number = np.searchsorted(feeds, starts) + row  # lines end at a feed or with the row
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    line_row = row[first]
    begin = offsets[line_row].copy()
    after = np.searchsorted(feeds, starts[first])
    has = after > 0
    begin[has] = np.maximum(begin[has], feeds[after[has] - 1] + 1)
    end = offsets[line_row + 1].copy()
    has = after < len(feeds)
    end[has] = np.minimum(end[has], feeds[after[has]])
    lines, _ = unique_words(data, begin, end)
    _, new = np.unique(_codes(lines.astype(np.int64), line_row), return_index=True)
    out["n_dup_lines"] = per_row(line_row) - per_row(line_row[new])

    lower = byte_hashes(w.lower() for w in distinct.to_pylist())[code]  # bytes: A-Z only
    place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    sums = np.add.reduceat(mix64(lower + mix64(place.astype(np.uint64))), first)
    count = np.diff(np.append(first, len(code)))
    normal = mix64(sums ^ count.astype(np.uint64)).view(np.int64)
    out_lines = []
    for at, to in zip(np.searchsorted(line_row, np.arange(n)), np.searchsorted(line_row, np.arange(n), "right"), strict=True):
        values, where = np.unique(normal[at:to], return_inverse=True)
        out_lines.append((values, np.bincount(where, count[at:to], len(values)).astype(np.int64)))
    return out, out_lines


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in text_slices(batch.column("text"), 2 << 20):
            counts, lines = text_features(data, offsets)
            n = len(offsets) - 1
            whole = byte_hashes(data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)).view(np.int64)
            lists = [pa.ListArray.from_arrays(np.cumsum([0, *(len(x[k]) for x in lines)]).astype(np.int32), np.concatenate([x[k] for x in lines])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), batch.column("host").slice(at, n), *(pa.array(counts[c]) for c in _COUNTS), pa.array(whole), *lists], schema=_OUT)
    give_back()


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, host_share: float = 0.03, least_documents: int = 10, min_left: float = 0.5) -> DataFrame:
    """One row per document of (doc_id, text, source): base counts, base_failed, words_left and kept.

    Base rules: fewer than ``min_words`` words, or more than ``max_repeat_percent`` % of them in repeated 3-word windows,
    fail. Cross-document rule: a normalised line is boilerplate of its host (the source) if it stands in at least
    ``least_documents`` documents of it and in more than ``host_share`` of them; documents with equal texts count once, so
    a copied page doesn't make its own lines boilerplate. Those lines go, and a document left with less than ``min_left``
    of its words, or with fewer than ``min_words``, is rejected if any line went.

    Null and empty texts have no words and fail; a null source is a host of its own; repeated rows each get
    a row; other columns are not read. An empty table gives an empty result.

    Lines travel as 8-byte hashes. Counts are partial sums before any shuffle, so a line that a third of all rows
    hold costs one row a task; the lines above the limits join back under adaptive execution, which broadcasts them
    only if their measured size allows and otherwise splits the hot ones.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("source").cast("string").alias("host"))
    schema = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, line_hashes array<long>, line_words array<long>"
    base = durable(rows.mapInArrow(_features, schema).withColumn("row", F.monotonically_increasing_id()))
    host = F.coalesce(F.concat(F.lit("="), "host"), F.lit("null")).alias("host")
    lines = base.select("row", host, "text_hash", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("line")).select("row", "host", "text_hash", F.col("line.line_hashes").alias("line"), F.col("line.line_words").alias("words"))
    common = lines.select("host", "line", "text_hash").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_documents)
    sizes = base.select(host, "text_hash").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    above = common.join(sizes, "host").where(F.col("n") > host_share * F.col("documents")).select("host", "line")
    gone = lines.select("row", "host", "line", "words").join(above, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("gone"))
    counts = base.drop("line_hashes", "line_words", "text_hash").join(gone, "row", "left").withColumn("words_left", F.col("n_words") - F.coalesce("gone", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = F.col("gone").isNotNull() & ((F.col("words_left") < min_left * F.col("n_words")) | (F.col("words_left") < min_words))
    return counts.select("doc_id", *_COUNTS, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "words_left")
