"""Near duplicates by SimHash: all fingerprints within a Hamming distance, found by a generalised pigeonhole index."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotloom.llm.common import byte_hashes, durable, give_back, let_go, lower_ascii, mix64, ragged, small_batches, text_slices, unique_words, word_bounds
from plotloom.llm.components import components

_BITS = 64


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash of each row: a bit is 1 if it is set in over half of the XXH64 values of the row's shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    starts, ends, row = word_bounds(data, offsets)
    text = lower_ascii(data)
    sizes = ends - starts
    # the words with one space between them, so that a shingle is one slice
    at = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    if len(starts):
        lengths = np.repeat(starts - at, sizes)
        place = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)
        joined[place] = text[place + lengths]
    body = joined.tobytes()
    first = np.searchsorted(row, np.arange(len(offsets)))
    out = np.zeros(len(offsets) - 1, np.uint64)
    begin, end = at.tolist(), (at + sizes).tolist()
    for i in range(len(out)):
        low, high = int(first[i]), int(first[i + 1])
        if low == high:
            continue
        last = max(low, high - words)
        total = np.zeros(_BITS, np.int64)
        for k in range(low, last + 1, 65536):
            to = min(last + 1, k + 65536)
            hashes = np.array([digest(body[b:e], seed) for b, e in zip(begin[k:to], end[min(k + words, high) - 1 : min(to + words - 1, high)], strict=True)], "<u8")
            total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        bits = (2 * total > last + 1 - low).astype(np.uint64)
        out[i] = (bits << np.arange(_BITS, dtype=np.uint64)).sum(dtype=np.uint64)
    return out


@dataclass(frozen=True)
class Pigeonholes:
    """Groups of bits with a threshold each; two fingerprints within the distance are within some group's threshold there.

    Thresholds of -1 leave a group out. They sum to distance - groups + 1, which proves the claim: otherwise every group
    would differ in at least threshold + 1 bits, distance + 1 in all.
    """

    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]

    @staticmethod
    def group_bits(together: np.ndarray, total: int, groups: int) -> tuple[tuple[int, ...], ...]:
        """Puts correlated bits together: each group grows from the most correlated free bit by the bit closest to it on average.

        together[i, j]: in how many fingerprints bits i and j are both 1.
        """
        p = np.diag(together) / max(1, total)
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        link = np.abs((together / max(1, total) - np.outer(p, p)) / np.outer(spread, spread))
        np.fill_diagonal(link, 0)
        free, out = list(range(len(p))), []
        for g in range(groups):
            width = len(free) // (groups - g)
            own = [max(free, key=lambda b: (link[b, free].sum(), -b))]
            free.remove(own[0])
            while len(own) < width:
                best = max(free, key=lambda b: (link[b, own].mean(), -b))
                own.append(best)
                free.remove(best)
            out.append(tuple(sorted(own)))
        return tuple(out)

    @staticmethod
    def ball(width: int, radius: int) -> np.ndarray:
        return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)

    @classmethod
    def allocate(cls, groups: Sequence[tuple[int, ...]], histograms: Sequence[np.ndarray], distance: int, key_cost: float = 4.0, most: int = 2) -> Pigeonholes:
        """Thresholds by dynamic programming on the estimated cost of each group and threshold.

        The cost of radius t is the number of pairs of fingerprints within t in that group, from the histogram of
        the group's values over all fingerprints, plus ``key_cost`` for each key that is written.
        """
        wanted = distance - len(groups) + 1
        choices = []
        for g, h in zip(groups, histograms, strict=True):
            h = h.astype(np.float64)
            costs = {-1: 0.0}
            near, at = np.zeros_like(h), np.arange(len(h))
            for t in range(min(most, distance) + 1):
                ball = cls.ball(len(g), t)
                for m in ball[len(cls.ball(len(g), t - 1)) if t else 0 :]:
                    near += h[at ^ m]
                costs[t] = float((h * near).sum() / 2 + key_cost * len(ball) * h.sum())
            choices.append(costs)
        best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for costs in choices:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for done, (cost, taken) in best.items():
                for t, c in costs.items():
                    if done + t not in step or cost + c < step[done + t][0]:
                        step[done + t] = (cost + c, (*taken, t))
            best = step
        return cls(tuple(groups), best[wanted][1])

    def values(self, prints: np.ndarray, group: int) -> np.ndarray:
        out = np.zeros(len(prints), np.int64)
        for k, b in enumerate(self.groups[group]):
            out |= ((prints >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
        return out


def _links(prints: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever all links within one large bucket connect: a search that meets each member once."""
    left = np.unique(prints)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            near = np.bitwise_count(left ^ one) <= distance
            if near.any():
                found, left = left[near], left[~near]
                front.extend(found)
                yield np.full(len(found), one), found


def _verify(batches: Iterator[pa.RecordBatch], distance: int, small: int = 32) -> Iterator[pa.RecordBatch]:
    """Links (a, b) among rows (key, print) that come sorted by key; a bucket may span batches."""

    def emit(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def work(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(begin, len(keys)))
        size = np.repeat(sizes, sizes)
        few = size <= small
        k, p = keys[few], prints[few]
        for lag in range(1, int(sizes[sizes <= small].max(initial=1))):
            hit = np.flatnonzero((k[lag:] == k[:-lag]) & (np.bitwise_count(p[lag:] ^ p[:-lag]) <= distance))
            if len(hit):
                yield emit(p[hit], p[hit + lag])
        for at, n in zip(begin[sizes > small], sizes[sizes > small], strict=True):
            for a, b in _links(prints[at : at + n], distance):
                yield emit(a, b)

    held_k, held_p = [], []
    for batch in batches:
        keys, prints = batch.column("key").to_numpy(), batch.column("print").to_numpy().view(np.uint64)
        if not len(keys):
            continue
        if held_k and keys[0] == keys[-1] == held_k[-1][-1]:
            held_k.append(keys), held_p.append(prints)
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        yield from work(np.concatenate([*held_k, keys[:cut]]), np.concatenate([*held_p, prints[:cut]]))
        held_k, held_p = [keys[cut:]], [prints[cut:]]
    if held_k:
        yield from work(np.concatenate(held_k), np.concatenate(held_p))


def similar_groups(prints: DataFrame, distance: int = 3, groups: int = 4, most_bucket: int = 16384) -> DataFrame:
    """(print, root) of the distinct 64-bit numbers ``print`` that have a link: root names the connected component.

    Bit statistics, value histograms and bucket keys cover all fingerprints. A bucket of more than ``most_bucket``
    fingerprints is cut again by the bits its key doesn't fix (by the same pigeonhole rule, exact), so no task holds an
    unbounded one; inside a bucket, links are kept only as far as they connect something new. Repeated prints count once; ``print`` isn't
    null; an empty table gives an empty result.
    """
    spark = prints.sparkSession
    distinct = durable(prints.select("print").distinct())

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_BITS, _BITS), np.int64)
        for b in batches:
            bits = np.unpackbits(b.column("print").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BITS * _BITS)), pa.array(total.ravel())], ["cell", "n"])

    together = np.zeros(_BITS * _BITS, np.int64)
    total = distinct.count()
    for r in distinct.mapInArrow(pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        together[r.cell] = r.n
    parts = Pigeonholes.group_bits(together.reshape(_BITS, _BITS), total, groups)
    plain = Pigeonholes(parts, (0,) * groups)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.zeros(1 << len(g), np.int64) for g in parts]
        for b in batches:
            x = b.column("print").to_numpy().view(np.uint64)
            for g, h in enumerate(own):
                h += np.bincount(plain.values(x, g), minlength=len(h))
        for g, h in enumerate(own):
            at = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(at.astype(np.int32)), pa.array(h[at])], ["part", "value", "n"])

    histograms = [np.zeros(1 << len(g), np.int64) for g in parts]
    seen = distinct.mapInArrow(count, "part int, value int, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()  # groups * 2**16 rows at most
    for g, h in enumerate(histograms):
        own = seen["part"].to_numpy() == g
        h[seen["value"].to_numpy()[own]] = seen["n"].to_numpy()[own]
    holes = Pigeonholes.allocate(parts, histograms, distance)
    masks = [np.uint64(sum(1 << b for b in g)) for g in parts]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 5000):
                x = b.column("print").slice(at, 5000).to_numpy().view(np.uint64)
                for g, t in enumerate(holes.thresholds):
                    for m in Pigeonholes.ball(len(parts[g]), t) if t >= 0 else ():
                        key = mix64((holes.values(x, g) ^ m).astype(np.uint64) | np.uint64((g + 1) << 40)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(x.view(np.int64)), pa.array(np.full(len(x), masks[g]).view(np.int64))], ["key", "print", "fixed"])

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, x, fixed = (b.column(c).to_numpy().view(np.uint64) for c in ("key", "print", "fixed"))
            for f in np.unique(fixed):
                own = fixed == f
                free = [i for i in range(_BITS) if not int(f) >> i & 1]
                for j, some in enumerate(np.array_split(free, distance + 1)):
                    mask = np.uint64(sum(1 << int(i) for i in some))
                    new = mix64(mix64(key[own] + np.uint64(j + 1)) ^ (x[own] & mask))
                    yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(x[own].view(np.int64)), pa.array(np.full(own.sum(), f | mask).view(np.int64))], ["key", "print", "fixed"])

    schema = "key long, print long, fixed long"
    level = distinct.mapInArrow(keys, schema)
    ready = []
    while True:
        level = durable(level)
        large = durable(level.groupBy("key", "fixed").agg(F.count("*").alias("n")).where((F.col("n") > most_bucket) & (F.bit_count(F.bitwise_not("fixed")) > distance)))
        if large.isEmpty():
            ready.append(level)
            break
        ready.append(level.join(large, ["key", "fixed"], "left_anti"))
        level = level.join(large, ["key", "fixed"], "left_semi").select("key", "print", "fixed").mapInArrow(refine, schema)
    links = []
    for part in ready:
        sorted_ = part.select("key", "print").repartition("key").sortWithinPartitions("key")
        links.append(sorted_.mapInArrow(lambda b: _verify(b, distance), "a long, b long"))
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    return components(edges).select(F.col("node").alias("print"), "root")


def fingerprint_table(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, print) of all rows; print is the fingerprint as a signed 64-bit number. Written to the checkpoint folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in text_slices(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(offsets) - 1), pa.array(fingerprints(data, offsets, words).view(np.int64))], ["doc_id", "print"])
        give_back()

    small_batches(docs.sparkSession)
    return durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long"))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, fingerprint (16 lowercase hex digits), component_id.

    Fingerprints that differ in at most ``distance`` bits are linked; component_id is the smallest doc_id of the connected
    component. A text of fewer than ``words`` words is one shingle; a null text or one without words has fingerprint 0 and is
    linked like any other. Documents with equal fingerprints meet only as one fingerprint. Null doc_ids stay null and
    never name a component (a component of only such rows has a null component_id); repeated rows each get a row;
    other columns are not read; an empty table gives an empty result.
    """
    table = fingerprint_table(docs, words)
    roots = similar_groups(table, distance)
    own = table.groupBy("print").agg(F.min("doc_id").alias("least")).join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = own.join(own.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("print", "component_id")
    return table.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the rows' sets of word shingles, each sorted: row i has hashes[bounds[i] : bounds[i + 1]].

    The words are lower-cased in A-Z and stand one space apart; a text of fewer words is one shingle, one without words has none.
    """
    starts, ends, row = word_bounds(data, offsets)
    bounds = np.zeros(len(offsets), np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    code, distinct = unique_words(lower_ascii(data), starts, ends)
    each = byte_hashes(distinct.to_pylist())[code]
    first = np.searchsorted(row, np.arange(len(offsets)))
    place, end = np.arange(len(starts)), first[row + 1]
    whole = (place + words <= end) | (place == first[row])  # a row of fewer words is one shingle
    at, end = place[whole], end[whole]
    hashes = np.full(len(at), 1, np.uint64)
    for k in range(words):
        hashes = np.where(at + k < end, mix64(hashes + each[np.minimum(at + k, len(each) - 1)]), hashes)
    row = row[whole]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))
    bounds[1:] = np.cumsum(np.bincount(row[new], minlength=len(offsets) - 1))
    return hashes[new], bounds


def band_keys(hashes: np.ndarray, bounds: np.ndarray, bands: int, rows: int, seed: int = 0) -> np.ndarray:
    """A key for each set and band, of ``rows`` MinHash values each; sets of Jaccard similarity s share one of them with probability 1 - (1 - s ** rows) ** bands."""
    out = np.zeros((len(bounds) - 1, bands), np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return out
    seeds = mix64((np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1, 2)
    for band in range(bands):
        key = np.full(len(some), band + 1, np.uint64)
        for flip, factor in seeds[band * rows : (band + 1) * rows]:
            key = mix64(key + np.minimum.reduceat((hashes ^ flip) * (factor | np.uint64(1)), bounds[some]))
        out[some, band] = key
    return out


def _spanning(names: np.ndarray, flat: np.ndarray, bounds: np.ndarray, roots: np.ndarray, similarity: Fraction) -> Iterator[tuple[int, int]]:
    """Links that connect whatever all links among these sets connect; set i is flat[bounds[i] : bounds[i + 1]], and sets of one root are connected already.

    A search that takes each set once and meets only those that nothing has reached yet.
    """
    up, down = similarity.numerator, similarity.denominator
    sizes = np.diff(bounds)
    distinct, code = np.unique(flat, return_inverse=True)
    _, kin = np.unique(roots, return_inverse=True)
    marked = np.zeros(len(distinct), bool)

    def without(left: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left = left[~gone[kin[left]]]
        return left, code[ragged(bounds[left], sizes[left])], np.cumsum(sizes[left]) - sizes[left]

    first = np.argsort(-np.bincount(kin)[kin], kind="stable")  # from the largest kin on
    left, body, starts = without(np.arange(len(names)), np.zeros(len(names), bool))
    for start in first:
        if not len(left):
            return
        if kin[start] not in kin[left]:
            continue
        gone = np.zeros(len(names), bool)
        gone[kin[start]] = True
        front = left[kin[left] == kin[start]].tolist()
        left, body, starts = without(left, gone)
        while front and len(left):
            one = front.pop()
            own = code[bounds[one] : bounds[one + 1]]
            marked[own] = True
            common = np.add.reduceat(marked[body].astype(np.int64), starts)
            marked[own] = False
            near = left[common * (up + down) >= (sizes[left] + sizes[one]) * up]
            if len(near):
                met, at = np.unique(kin[near], return_index=True)
                yield from ((int(names[one]), int(names[i])) for i in near[at])
                gone[met] = True
                front.extend(left[gone[kin[left]]].tolist())
                left, body, starts = without(left, gone)


def _linked(batches: Iterator[pa.RecordBatch], similarity: Fraction) -> Iterator[pa.RecordBatch]:
    """Links (a, b) among rows (task, set, root, shingles) that come sorted by task; a task may span batches."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        tasks = table["task"].to_numpy()
        names, roots = table["set"].to_numpy(), table["root"].to_numpy()
        bodies = table["shingles"].to_pylist()
        flat, bounds = _numbers(b"".join(bodies)), np.append(0, np.cumsum([len(x) // 6 for x in bodies]))
        edges = np.flatnonzero(np.append(tasks[1:] != tasks[:-1], True)) + 1
        out = []
        for low, high in zip(np.append(0, edges[:-1]), edges, strict=True):
            out.extend(_spanning(names[low:high], flat[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], roots[low:high], similarity))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tasks = batch.column("task").to_numpy()
        cut = int(np.searchsorted(tasks, tasks[-1]))
        if cut or (held and held[-1].column("task")[-1].as_py() != tasks[0]):
            yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from work(pa.Table.from_batches(held))
    give_back()


def _packed(hashes: np.ndarray) -> bytes:
    """48 bits of each, ascending, once."""
    return np.unique(hashes >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _numbers(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


#: Bands and MinHash values in each by which a bucket is parted again, and how often at most.
DEEP, LEVELS = (40, 8), 3


def similar_sets(docs: DataFrame, words: int, similarity: Fraction, bands: int, rows: int, most: int = 4096, distance: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, copy, set) of all rows and (set, root) of the sets that have a link: root names the connected component.

    ``copy`` is the text's MD5, ``set`` a hash of its shingles; sets are linked whose Jaccard similarity, counted on the whole sets (48 bits of
    each shingle's hash), is ``similarity`` or more. Candidates are sets whose SimHash fingerprints are linked, over ``distance`` bits or fewer at a time, and, as
    fewer bits than a near copy may differ in, those that share a MinHash band. Each bucket, a component of fingerprints or of a band, without those that repeat another's members, comes with its
    sets to one task, which searches for links that span what all links connect, so that pairs are never rows. A bucket of more than
    ``most`` sets is dealt to blocks, each with the bucket's least set; what the blocks leave apart from the
    bucket's largest component then meets every block. Where that is more than ``most`` sets, so that it would meet the blocks again and again, the bucket is
    parted by further bands instead, of ``DEEP`` MinHash values, in which a pair of similarity 0.8 meets with probability 0.9994; what is
    as large after ``LEVELS`` such partings meets every block, ``most`` sets at a time, so that no candidate is left out.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in text_slices(b.column("text")):
                n = len(offsets) - 1
                hashes, bounds = shingle_sets(data, offsets, words)
                sums = np.append(np.uint64(0), np.cumsum(mix64(hashes), dtype=np.uint64))
                size = np.diff(bounds)
                name = mix64(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(np.uint64)).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32)), pa.array(band_keys(hashes, bounds, bands, rows).ravel().view(np.int64)))
                prints = pa.array(fingerprints(data, offsets, words).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, n), b.column("copy").slice(at, n), pa.array(name), pa.array(size), prints, keys], ["doc_id", "copy", "set", "size", "print", "keys"])
        give_back()

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in text_slices(b.column("text")):
                hashes, bounds = shingle_sets(data, offsets, words)
                sets = [_packed(hashes[low:high]) for low, high in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("set").slice(at, len(sets)), pa.array(sets, pa.binary())], ["set", "shingles"])
        give_back()

    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_md5().alias("copy"), "text")
    table = durable(texts.mapInArrow(sign, "doc_id long, copy string, set long, size long, print long, keys array<long>"))
    prints = table.where("size > 0").select("set", "print").distinct()
    linked = prints.join(similar_groups(prints, distance), "print", "left").select("set", F.xxhash64(F.lit("print"), F.coalesce("root", "print")).alias("key"))
    members = table.where("size > 0").select("set", F.explode("keys").alias("key")).unionByName(linked).distinct()
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.min("set").alias("low"), F.bit_xor(F.xxhash64("set")).alias("sum")).where("n > 1")
    buckets = buckets.groupBy("n", "low", "sum").agg(F.min("key").alias("key"))  # of buckets with the same members, one
    shared = durable(members.join(buckets.select("key", "n", "low"), "key"))
    let_go(docs.sparkSession)  # of the shuffle files behind what is stored now, here and below
    wanted = table.groupBy("set").agg(F.min("copy").alias("copy")).join(shared.select("set").distinct(), "set", "left_semi")  # counted first, as one set may be most rows'
    single = texts.groupBy("copy").agg(F.first("text").alias("text"))  # copies go before they travel, and the join takes the rows as they lie
    sets = durable(single.join(wanted, "copy").select("set", "text").mapInArrow(shingles, "set long, shingles binary"))
    let_go(docs.sparkSession)

    def links(tasks: DataFrame) -> DataFrame:
        """The spanning links of rows (task, set, root)."""
        dealt = tasks.join(sets, "set").select("task", "set", "root", "shingles").repartition("task").sortWithinPartitions("task")
        found = durable(dealt.mapInArrow(lambda b: _linked(b, similarity), "a long, b long"))
        let_go(docs.sparkSession)
        return found

    def parted(own: DataFrame, level: int) -> DataFrame:
        """(key, set, root, n, low): the sets of the buckets of own (key, set, root) in buckets by further bands."""

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bodies = b.column("shingles").to_pylist()
                keys = band_keys(_numbers(b"".join(bodies)), np.append(0, np.cumsum([len(x) // 6 for x in bodies])), *DEEP, level).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, DEEP[0], dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("set"), lists], ["set", "keys"])

        further = sets.join(own.select("set").distinct(), "set", "left_semi").mapInArrow(keyed, "set long, keys array<long>")
        inner = own.join(further, "set").select("set", "root", F.explode("keys").alias("inner"), "key").select("set", "root", F.xxhash64("key", "inner").alias("key")).distinct()
        found = inner.groupBy("key").agg(F.count("*").alias("n"), F.min("set").alias("low"), F.bit_xor(F.xxhash64("set")).alias("sum"), F.min("root").alias("a"), F.max("root").alias("b")).where("n > 1 AND a <> b")
        found = found.groupBy("n", "low", "sum").agg(F.min("key").alias("key"))
        return durable(inner.join(found.select("key", "n", "low"), "key"))

    def met(shared: DataFrame, level: int) -> DataFrame:
        """Links that span what the links inside the buckets (key, set, root, n, low) connect, where sets of one root are connected before."""
        blocks = F.ceil(F.col("n") / most)
        own = shared.withColumn("block", F.pmod(F.xxhash64("set", F.lit(1)), blocks))
        pilots = shared.where((F.col("n") > most) & (F.col("set") == F.col("low"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        every = own.select("key", "block", "set", "root").unionByName(pilots.select("key", "block", "set", "root")).distinct() if not pilots.isEmpty() else own
        edges = links(every.select(F.xxhash64("key", "block").alias("task"), "set", "root"))
        large = shared.where(F.col("n") > most)
        if large.isEmpty():
            return edges
        known = large.where("root <> set").select(F.col("set").alias("a"), F.col("root").alias("b")).distinct()
        roots = components(edges.unionByName(known) if level else edges).select(F.col("node").alias("set"), F.col("root").alias("now"))
        own = durable(own.where(F.col("n") > most).join(roots, "set", "left").withColumn("root", F.coalesce("now", "root")).drop("now"))
        counted = own.groupBy("key", "root").agg(F.count("*").alias("rows"))
        main = counted.groupBy("key").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.sum("rows").alias("all"), F.max("rows").alias("most"))
        apart = durable(main.where("all > most").select("key", "main", F.ceil((F.col("all") - F.col("most")) / most).alias("turns")))
        if level < LEVELS:
            deep = own.join(apart.where("turns > 1").select("key"), "key", "left_semi").select("key", "set", "root")
            if not deep.isEmpty():
                edges = edges.unionByName(met(parted(deep, level + 1), level + 1))
            apart = apart.where("turns = 1")
        own = own.join(apart, "key")
        loose = own.where("root <> main").withColumn("turn", F.pmod(F.xxhash64("set", F.lit(2)), F.col("turns")))
        probes = loose.select("key", "set", "root", "turn", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
        base = own.select("key", "set", "root", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"))
        both = base.select("key", "block", "turn", "set", "root").unionByName(probes.select("key", "block", "turn", "set", "root")).distinct()
        return edges.unionByName(links(both.select(F.xxhash64("key", "block", "turn").alias("task"), "set", "root")))

    edges = met(shared.withColumn("root", F.col("set")), 0)
    return table.select("doc_id", "copy", "set"), components(edges).select(F.col("node").alias("set"), "root")


def text_md5() -> Column:
    return F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: Fraction = Fraction(4, 5), bands: int = 20, rows: int = 4, most: int = 4096, distance: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest doc_id, then the smallest MD5 of its text; null doc_ids come last.

    Texts are linked whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and a group is a connected component.
    Candidates come from SimHash, whose fingerprints link at ``distance`` or fewer bits, and beyond its reach from MinHash bands.
    Every pair of candidates is checked exactly; by the bands alone a pair of similarity 0.8 is a candidate with probability 0.99997, a closer
    one more surely. Rows are told apart by doc_id and text, so a doc_id that repeats with
    different texts loses none of them for its number; of rows equal in both, one stays. Null and empty texts and others without words are copies
    of one another. An empty table stays empty; extra columns of any name are carried along.
    """
    table, roots = similar_sets(docs, words, similarity, bands, rows, most, distance)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "copy")
    kept = table.groupBy("set").agg(F.min(order).alias("least")).join(roots, "set", "left").groupBy(F.coalesce("root", "set").alias("group")).agg(F.min("least").alias("least"))
    keys = ["_kept_copy", "_kept_id", "_kept_null"]  # joined and told apart by the same columns, so that texts travel once
    kept = kept.select(F.col("least.copy").alias("_kept_copy"), F.coalesce("least.doc_id", F.lit(0)).alias("_kept_id"), F.col("least.last").alias("_kept_null"))
    number = F.col("doc_id").cast("long")
    rows_ = docs.withColumns({"_kept_copy": text_md5(), "_kept_id": F.coalesce(number, F.lit(0)), "_kept_null": number.isNull()})
    return rows_.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)
