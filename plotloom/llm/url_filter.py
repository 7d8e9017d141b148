"""URL filters: rules for hosts and paths, and a ratio of two character models for what no rule covers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotloom.llm.common import durable

#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_ORDER, _EDGE, _BINS, _SPAN = 5, 2, 4000, 8.0
#: Rows that are scored together.
_PART = 20_000
#: (bytes to skip, bytes to take) of a gram: pair 2, context 3, pair 3, context 4, pair 4, context 5, pair 5.
_SLOTS = ((0, 3), (1, 3), (0, 4), (1, 4), (0, 5), (1, 5), (0, 6))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty for null or where there is no '://'."""
    rest = F.when(url.contains("://"), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null. A rule fits its host and all subdomains, if the path starts with the rule's."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out.otherwise(None) if out is not None else F.lit(None).cast("string")


# --- two variable-order Markov models over UTF-8 bytes ---------------------------------------------
#
# A byte's probability after its last k bytes is (n(context, byte) + prior * p_shorter) / (n(context) + prior): the longest
# context that was seen speaks loudest, unseen ones pass the shorter one's answer on; before order 0 all bytes are alike.
# A byte and the five before it (its gram, 48 bits, the byte itself lowest) fix all its counts.


def grams(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(gram of each byte of the URLs, offsets of the URLs); before a URL stand edge bytes, null is empty."""
    column = pc.fill_null(urls, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.int64) if data is not None and data.size else np.zeros(0, np.int64)
    offsets = offsets - offsets[0]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = data.copy()
    for k in range(1, _ORDER + 1):
        before = np.full(len(data), _EDGE, np.int64)
        before[k:] = np.where(place[k:] >= k, data[:-k], _EDGE)
        out |= before << (8 * k)
    return out, offsets


def _keys(gram: Column) -> list[Column]:
    """A key for each count that has more than two bytes to it: contexts and pairs of the higher orders, in ``_SLOTS`` order."""
    return [F.lit(slot << 48) + F.shiftright(gram, 8 * skip).bitwiseAND(F.lit((1 << 8 * size) - 1)) for slot, (skip, size) in enumerate(_SLOTS)]


def count_grams(labelled: DataFrame) -> DataFrame:
    """(gram, n0, n1): how often each gram is in the rejected and in the accepted URLs (url, accepted). Written to the checkpoint folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            accepted = b.column("accepted").to_numpy(zero_copy_only=False).astype(np.int64)
            all_, offsets = grams(b.column("url"))
            found, at = np.unique(all_, return_inverse=True)
            label = np.repeat(accepted, np.diff(offsets))
            sides = [pa.array(np.bincount(at[label == y], minlength=len(found))) for y in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(found), *sides], ["gram", "n0", "n1"])

    return durable(labelled.mapInArrow(run, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def gram_terms(wanted: DataFrame, counts: DataFrame, prior: float) -> DataFrame:
    """(gram, term) of the distinct ``wanted`` grams: log p(accepted) - log p(rejected) of the byte, from exact counts.

    Counts over up to two bytes come as whole tables of 2**16 cells at most, which is all the values two bytes have; the others stay
    distributed and meet the grams by their key.
    """

    def dense(skip: int) -> np.ndarray:
        out = np.zeros((2, 1 << 16))
        found = counts.groupBy(F.shiftright("gram", skip).bitwiseAND(F.lit(0xFFFF)).alias("cell")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
        for y in (0, 1):
            out[y, found["cell"].to_numpy()] = found[f"n{y}"].to_numpy()
        return out

    pair, context = dense(0), dense(8)
    low = wanted.sparkSession.sparkContext.broadcast((pair, context, pair.reshape(2, 256, 256).sum(1), pair.reshape(2, 256, 256).sum(2)))
    known = counts.select(F.explode(F.array(*_keys(F.col("gram")))).alias("key"), "n0", "n1").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    slots = wanted.select("gram", F.posexplode(F.array(*_keys(F.col("gram")))).alias("slot", "key")).join(known, "key", "left")
    names = [f"s{k}_{y}" for k in range(len(_SLOTS)) for y in (0, 1)]
    wide = slots.groupBy("gram").agg(*(F.coalesce(F.sum(F.when(F.col("slot") == k, F.col(f"n{y}"))), F.lit(0)).alias(f"s{k}_{y}") for k in range(len(_SLOTS)) for y in (0, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, context, single, before = low.value
        for b in batches:
            gram = b.column("gram").to_numpy()
            n = {name: b.column(name).to_numpy().astype(np.float64) for name in names}
            log = []
            for y in (0, 1):
                higher = [n[f"s{k}_{y}"] for k in range(len(_SLOTS))]
                # (pair, context) of orders 0 to 5
                levels = [(single[y, gram & 0xFF], single[y].sum()), (pair[y, gram & 0xFFFF], before[y, gram >> 8 & 0xFF]), (higher[0], context[y, gram >> 8 & 0xFFFF])]
                levels += [(higher[2 * k], higher[2 * k - 1]) for k in (1, 2, 3)]
                p = np.full(len(gram), 1 / 256)
                for hits, seen in levels:
                    p = (hits + prior * p) / (seen + prior)
                log.append(np.log(p))
            yield pa.RecordBatch.from_arrays([b.column("gram"), pa.array(log[1] - log[0])], ["gram", "term"])

    return durable(wide.mapInArrow(run, "gram long, term double"))


def scored(rows: DataFrame, counts: DataFrame, prior: float) -> DataFrame:
    """``rows`` (with ``url`` and ``part``) with ``score``: the mean of the URL's terms, 0 for null and empty.

    A part's distinct grams go to their terms and come back to its rows, of which ``_PART`` are together at most.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column("part").to_numpy()
            all_, offsets = grams(b.column("url"))
            owner = np.repeat(part, np.diff(offsets))
            for p in np.unique(part):
                own = np.unique(all_[owner == p])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), p)), pa.array(own)], ["part", "gram"])

    needed = durable(rows.select("part", "url").mapInArrow(distinct, "part long, gram long").distinct())
    terms = gram_terms(needed.select("gram").distinct(), counts, prior)

    def judge(own: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("gram")
        gram, term = known["gram"].to_numpy(), known["term"].to_numpy()
        all_, offsets = grams(pa.concat_arrays(own["url"].chunks))
        sizes = np.diff(offsets)
        some, scores = sizes > 0, np.zeros(len(sizes))
        if some.any():
            scores[some] = np.add.reduceat(term[np.searchsorted(gram, all_)], offsets[:-1][some]) / sizes[some]
        return own.append_column("score", pa.array(scores))

    back = needed.join(terms, "gram").groupBy("part")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return durable(rows.groupBy("part").cogroup(back).applyInArrow(judge, f"{kinds}, score double"))


def calibrated(judged: DataFrame) -> float:
    """The score with the best mean of the two classes' rates of right answers, over the distinct (url, accepted, score) left out of the counts."""
    cell = F.greatest(F.lit(0), F.least(F.lit(_BINS - 1), F.floor((F.col("score") + _SPAN) * (_BINS / (2 * _SPAN))))).cast("int")
    seen = np.zeros((2, _BINS))
    for r in judged.distinct().groupBy(F.col("accepted").cast("int").alias("accepted"), cell.alias("cell")).agg(F.count("*").alias("n")).collect():
        seen[r.accepted, r.cell] = r.n
    if not (seen[0].any() and seen[1].any()):
        return 0.0
    right = np.cumsum(seen[0]) / seen[0].sum() + (1 - np.cumsum(seen[1]) / seen[1].sum())
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((best.min() + best.max() + 2) / 2 * (2 * _SPAN) / _BINS - _SPAN)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, prior: float = 2.0) -> DataFrame:
    """One row per page of (page_id, url): page_id, host, path, rule, verdict and score.

    The verdict is the longest fitting rule's; without one, ``allow`` if the length-normalised log-likelihood ratio of the
    accepted and the rejected model reaches the calibrated threshold, else ``block``. The models learn from the URLs that
    rules accept or reject, each distinct URL once, however many rows repeat it; every fifth by CRC-32 is left out of the counts and
    sets the threshold. Without rows of both kinds there is nothing to compare: the threshold is 0 and unruled URLs score whatever the counts give.

    A null URL, or one without '://', has an empty host and path and no rule; null and empty score 0. Repeated rows each get a
    row; null page_ids stay null; other columns are not read; an empty table gives an empty result. Counts are exact, in a
    distributed table that grows with the distinct ruled URLs.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    rows = rows.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33) * (1 << 20) + F.floor(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) / _PART)
    rows = durable(rows.withColumn("part", part.cast("long")).drop("_at"))
    ruled = F.create_map(*(F.lit(x) for rule in rules for x in rule))[F.col("rule")] if rules else F.lit(None).cast("string")
    left_out = F.crc32(F.encode("url", "UTF-8")) % 5 == 0
    labelled = rows.where("rule IS NOT NULL AND url IS NOT NULL").select("url", (ruled == "allow").alias("accepted")).distinct()
    counts = count_grams(labelled.where(~left_out))
    judged = scored(rows, counts, prior)
    both = counts.agg(F.sum("n0").alias("a"), F.sum("n1").alias("b")).first()
    threshold = calibrated(judged.where("rule IS NOT NULL").where(left_out).select("url", (ruled == "allow").alias("accepted"), "score")) if both.a and both.b else 0.0
    learned = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce(ruled, learned).alias("verdict"), "score")
