"""Exact substring dedup: bytes covered by a string that an earlier document holds too, found in suffix arrays.

Every 50-byte string has a smallest 24-byte substring by hash. Neighbouring strings of a document with the same smallest
value make one fragment, so that equal strings always lie in fragments with the same value, its class. Classes that only
one document has can't hold a repeat. The fragments of the other classes are brought together by class, equal
ones as one with their smallest doc_id, and each class's suffix array is built by linear Lyndon grouping. Equal strings
are neighbours in it and get the smallest doc_id of all fragments they stand in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotloom.llm.common import WORD, durable, durable_by, give_back, let_go, mix64, ragged, small_batches, text_slices
from plotloom.llm.lyndon import suffix_arrays

_STRING, _SEED_BYTES, _GROUP_BYTES, _BUCKET_BYTES, _PIECE = 50, 24, 2 << 20, 32 << 20, 1 << 18
#: Bytes of fragments that are sorted together.
_SORTED = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Classes of more distinct fragments than this are parted again by longer substrings before they are sorted.
_MANY = 16
#: A fragment has at most so many strings; the equal ones that a long run is cut into count as one.
_LONG = 2048
#: Classes that more groups than this have are parted again before they travel.
_HOT = 4096


def _rolling(data: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of each run of ``width`` bytes, put together from runs whose lengths are powers of two."""
    part = data.astype(np.uint64) + np.uint64(1)
    power, length, out, done = int(_BASE), 1, None, 0
    n = len(data)
    while True:
        if width & length:
            if out is None:
                out = part[: n - width + 1].copy() if length == width else part.copy()
            else:
                out = out[: n - done - length + 1] * np.uint64(power) + part[done : done + n - done - length + 1]
            done += length
        if done == width:
            return mix64(out + np.uint64(seed))
        part = part[:-length] * np.uint64(power) + part[length:]
        power = power * power % (1 << 64)
        length *= 2


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    length = 1
    while 2 * length <= width:
        values = np.minimum(values[:-length], values[length:])
        length *= 2
    return np.minimum(values[: len(values) - (width - length)], values[width - length :]) if length < width else values


def fragments(data: np.ndarray, offsets: np.ndarray, width: int = _SEED_BYTES, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, class) of the fragments of rows; start and end are places in ``data``.

    Each string of 50 bytes of a row lies in exactly one fragment, that of its class. Long stretches are worked in pieces, and
    a run that repeats its class's substring again and again is cut every ``_LONG`` strings.
    """
    parts = []
    for low in range(0, max(len(data) - _STRING + 1, 0), _PIECE):
        piece = data[low : low + _PIECE + _STRING - 1]
        least = _sliding_least(_rolling(piece, width, seed), _STRING - width + 1) >> np.uint64(16)  # 48 bits travel
        inner = offsets[1:-1]
        inner = inner[(inner > low) & (inner < low + len(least) + _STRING - 1)] - low
        cut = np.zeros(len(least) + _STRING, np.int32)  # strings that cross a row's end
        np.add.at(cut, np.maximum(inner - _STRING + 1, 0), 1)
        np.add.at(cut, np.minimum(inner, len(least)), -1)
        crosses = np.cumsum(cut)[: len(least)] > 0
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | crosses[:-1]
        new |= crosses
        border = np.flatnonzero(new)
        own = ~crosses[border]
        first, count = border[own], np.diff(np.append(border, len(least)))[own]
        if not len(first):
            continue
        pieces = -(-count // _LONG)
        first = np.repeat(first, pieces) + (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _LONG
        count = np.minimum(_LONG, np.repeat(count, pieces) - (first - np.repeat(border[own], pieces)))
        parts.append((np.searchsorted(offsets, low + first, "right") - 1, low + first, low + first + count - 1 + _STRING, least[first]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first fragment of each distinct (class, content), by class, then content; its number for each fragment)."""
    sizes = ends - starts
    packed = data[ragged(starts, sizes)]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
    code = text.indices.to_numpy().astype(np.int64)
    rank = np.empty(len(text.dictionary), np.int64)
    rank[pc.array_sort_indices(text.dictionary).to_numpy()] = np.arange(len(rank))
    order = np.lexsort((rank[code], classes))
    c, k = classes[order], code[order]
    new = np.ones(len(order), bool)
    new[1:] = (c[1:] != c[:-1]) | (k[1:] != k[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def earliest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, classes: np.ndarray, docs: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first string of each fragment, earliest): the smallest doc among all fragments of its class that hold each string of each fragment."""
    windows = ends - starts - _STRING + 1
    begin = np.concatenate([[0], np.cumsum(windows)])
    if not len(starts):
        return begin, np.zeros(0, np.int64)
    parts = -(-int((ends - starts).sum()) // _SORTED)
    if parts > 1:  # classes are independent, so memory stays that of one part
        share = (mix64(classes) % np.uint64(parts)).astype(np.int64)
        out = np.zeros(int(begin[-1]), np.int64)
        for part in range(parts):
            own = np.flatnonzero(share == part)
            out[ragged(begin[own], windows[own])] = _earliest(data, starts[own], ends[own], classes[own], docs[own], level)
        return begin, out
    return begin, _earliest(data, starts, ends, classes, docs, level)


def _earliest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, classes: np.ndarray, docs: np.ndarray, level: int) -> np.ndarray:
    windows = ends - starts - _STRING + 1
    if not len(starts):
        return np.zeros(0, np.int64)
    pick, number = _distinct(data, starts, ends, classes)
    least = np.full(len(pick), np.iinfo(np.int64).max)
    np.minimum.at(least, number, docs)
    s, e, c = starts[pick], ends[pick], classes[pick]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    rivals = np.diff(np.append(first, len(c)))
    each = np.repeat(rivals, rivals)
    own = np.concatenate([[0], np.cumsum(windows[pick])])
    out = np.repeat(least, windows[pick])  # a class of one fragment is in order as it is

    many = each > _MANY
    if level < 2 and many.any():
        at = np.flatnonzero(many)
        packed = data[ragged(s[at], (e - s)[at])]
        bounds = np.concatenate([[0], np.cumsum((e - s)[at])])
        row, fs, fe, fc = fragments(packed, bounds, (40, 50)[level], seed=level + 1)
        inner, found = earliest(packed, fs, fe, mix64(fc + mix64(c[at][row])), least[at][row], level + 1)
        place = own[at[row]] + fs - bounds[row]
        out[ragged(place, fe - fs - _STRING + 1)] = found
        each = np.where(many, 1, each)

    order = np.argsort(each, kind="stable")
    order = order[each[order] > 1]
    load = np.cumsum((e - s)[order] + 1)
    at = 0
    while at < len(order):  # classes of like size side by side
        to = int(np.searchsorted(load, (load[at - 1] if at else 0) + (_SORTED >> 1), "right"))
        to = max(to, at + 1)
        while to < len(order) and c[order[to]] == c[order[to - 1]]:
            to += 1
        some = np.sort(order[at:to])
        _sort_classes(data, s[some], e[some], c[some], least[some], own[some], out)
        at = to
    return out[ragged(own[number], windows)]


def _sort_classes(data: np.ndarray, s: np.ndarray, e: np.ndarray, c: np.ndarray, least: np.ndarray, own: np.ndarray, out: np.ndarray) -> None:
    """Writes to ``out`` the earliest doc of each string of the fragments, which come by class."""
    sizes = e - s
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.ones(int(begin[-1]), np.int16)  # the mark after each fragment
    spots = ragged(begin[:-1], sizes)
    text[spots] = data[ragged(s, sizes)].astype(np.int16) + 2
    ends_class = np.append(c[1:] != c[:-1], True)
    text[begin[1:][ends_class] - 1] = 0  # the end of each class
    strings = np.concatenate([[0], begin[1:][ends_class]])
    order = suffix_arrays(text, strings)
    fragment = np.searchsorted(begin, order, "right") - 1
    full = order + _STRING <= begin[fragment + 1] - 1
    order, fragment = order[full], fragment[full]
    klass = c[fragment]
    same = np.zeros(len(order), bool)
    step, block = np.arange(_STRING), 8192
    for low in range(1, len(order), block):
        a, b = order[low - 1 : low - 1 + block], order[low : low + block]
        a = a[: len(b)]
        same[low : low + len(b)] = (klass[low : low + len(b)] == klass[low - 1 : low - 1 + len(b)]) & (text[a[:, None] + step] == text[b[:, None] + step]).all(1)
    heads = np.flatnonzero(~same)
    if len(heads):
        runs = np.minimum.reduceat(least[fragment], heads)
        out[own[fragment] + order - begin[fragment]] = np.repeat(runs, np.diff(np.append(heads, len(order))))


def _pack(classes: np.ndarray) -> bytes:
    return classes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _candidates(key: pa.Table, hot: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, classes, whether over ``hot`` groups have it) that more than one document has, of one bucket of (gid, classes, shared)."""
    gids = key["gid"].to_numpy()
    classes = [_unpack(x) for x in key["classes"].to_pylist()]
    shared = [np.frombuffer(x, bool) for x in key["shared"].to_pylist()]
    sizes = np.array([len(x) for x in classes])
    flat, both = np.concatenate(classes), np.concatenate(shared)
    order = np.argsort(flat, kind="stable")
    v = flat[order]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    count = np.diff(np.append(first, len(v)))
    ok = (count > 1) | np.logical_or.reduceat(both[order], first)
    hit, wide = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    hit[order], wide[order] = np.repeat(ok, count), np.repeat(count > hot, count)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    for k, g in enumerate(gids):
        own = slice(edges[k], edges[k + 1])
        yield int(g), flat[own][hit[own]], wide[own][hit[own]]


class _Group:
    """The documents of one group, distinct by text, and their fragments."""

    def __init__(self, table: pa.Table) -> None:
        seen: dict[bytes, int] = {}
        bodies: dict[bytes, bytes] = {}
        for sha, doc, packed in zip(table["sha"].to_pylist(), table["doc_id"].to_pylist(), table["packed"].to_pylist(), strict=True):
            if sha not in seen or doc < seen[sha]:
                seen[sha] = doc
            bodies[sha] = packed
        self.shas = sorted(seen)
        self.docs = np.array([seen[x] for x in self.shas], np.int64)
        unpack = zstandard.ZstdDecompressor()
        texts = [unpack.decompress(bodies[x]) for x in self.shas]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.row, self.starts, self.ends, self.classes = fragments(self.data, self.offsets)

    def keep(self, wanted: np.ndarray, hot: np.ndarray) -> None:
        """Leaves the fragments of the wanted classes; of the hot ones among them only ``whole`` is left, the place of each string (equal ones that follow each other are one)."""
        ok = np.isin(self.classes, wanted)
        row, starts, ends, classes = self.row[ok], self.starts[ok], self.ends[ok], self.classes[ok]
        wide = np.isin(classes, wanted[hot])
        none = np.zeros(0, np.int64)
        self.whole = none, none, none
        if wide.any():
            sizes = (ends - starts)[wide]
            begin = np.concatenate([[0], np.cumsum(sizes)])
            of, low, high, _ = fragments(self.data[ragged(starts[wide], sizes)], begin, _STRING, seed=7)
            shift = starts[wide][of] - begin[of]
            self.whole = row[wide][of], low + shift, high + shift
        self.row, self.starts, self.ends, self.classes = row[~wide], starts[~wide], ends[~wide], classes[~wide]

    def names(self) -> list[bytes]:
        """128 bits of hash of each of the ``whole`` strings."""
        return [xxhash.xxh3_128_digest(self.data[s : s + _STRING]) for s in self.whole[1]]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first of each distinct fragment, its number for each fragment, its smallest doc, whether several docs have it)."""
        pick, number = _distinct(self.data, self.starts, self.ends, self.classes)
        docs = self.docs[self.row]
        low, high = np.full(len(pick), np.iinfo(np.int64).max), np.full(len(pick), np.iinfo(np.int64).min)
        np.minimum.at(low, number, docs)
        np.maximum.at(high, number, docs)
        return pick, number, low, high > low


def _by_bucket(classes: np.ndarray, buckets: int) -> dict[int, np.ndarray]:
    """The places of the classes of each bucket that has any."""
    bucket = (classes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    some, first = np.unique(bucket[order], return_index=True)
    return dict(zip(some.tolist(), np.split(order, first[1:]), strict=True)) if len(some) else {}


def removed_spans(docs: DataFrame, hot: int = _HOT, every: bool = False) -> DataFrame:
    """(sha, doc_id, n_removed, n_spans, kept_sha256, kept) of each distinct text of at least 50 bytes that holds doc_id, its smallest.

    Texts are dealt to groups of about two megabytes, compressed, once, and written to the checkpoint folder; classes, fragments and answers
    travel between groups and class buckets as packed arrays. Buckets are as many as shuffle partitions, or more where they
    would stand for over 32 MB of text. kept is the text without the removed bytes, null where nothing was removed, or
    with ``every`` the whole text there.

    A class that over ``hot`` groups have, like that of a line which all documents hold, sends no fragments: of each of its whole strings a group has only the
    smallest doc_id counts, so 128 bits of the string's hash and that number meet in a partial minimum before they travel, and the minimum
    joins back to the groups under adaptive execution, which splits a string that all groups ask for.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length("text").alias("n")).where(F.col("n") >= _STRING)
    total = rows.agg(F.sum(F.col("n").cast("long")).alias("n")).first().n or 0
    groups = max(1, -(-total // _GROUP_BYTES))
    buckets = max(parts, -(-total // _BUCKET_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for at, data, offsets in text_slices(b.column("text")):
                least: dict[bytes, tuple[int, int]] = {}
                for i in range(len(offsets) - 1):
                    sha = hashlib.sha256(data[offsets[i] : offsets[i + 1]]).digest()
                    if sha not in least or ids[at + i] < least[sha][0]:
                        least[sha] = (ids[at + i], i)
                gid = [int.from_bytes(x[:8], "little") % groups for x in least]
                packed = [pack.compress(data[offsets[i] : offsets[i + 1]].tobytes()) for _, i in least.values()]
                yield pa.RecordBatch.from_arrays([pa.array(gid, pa.int64()), pa.array(list(least), pa.binary()), pa.array([d for d, _ in least.values()], pa.int64()), pa.array(packed, pa.binary())], ["gid", "sha", "doc_id", "packed"])

    dealt = durable_by(rows.select("doc_id", "text").mapInArrow(deal, "gid long, sha binary, doc_id long, packed binary"), parts, "gid")

    def classes(key: tuple, table: pa.Table) -> pa.Table:
        g = _Group(table)
        distinct, where = np.unique(g.classes, return_inverse=True)
        low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, where, g.docs[g.row])
        np.maximum.at(high, where, g.docs[g.row])
        out = [(b, _pack(distinct[x]), (high > low)[x].tobytes()) for b, x in _by_bucket(distinct, buckets).items()]
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array(np.full(len(out), key[0].as_py()), pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "gid", "classes", "shared"])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        out = [(g, _pack(x), wide.tobytes(), bool(wide.any())) for g, x, wide in _candidates(table, hot) if len(x)]
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.bool_()))], ["gid", "classes", "hot", "any_hot"])

    def told_classes(wanted: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        classes, wide = wanted["classes"].drop_null().to_pylist(), wanted["hot"].drop_null().to_pylist()
        return np.concatenate([np.zeros(0, np.uint64), *map(_unpack, classes)]), np.concatenate([np.zeros(0, bool), *(np.frombuffer(x, bool) for x in wide)])

    def cut(key: tuple, table: pa.Table, wanted: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and wanted.num_rows:
            pack = zstandard.ZstdCompressor(level=3)
            g = _Group(table)
            g.keep(*told_classes(wanted))
            pick, _, low, several = g.distinct()
            for b, x in _by_bucket(g.classes[pick], buckets).items():
                p = pick[x]
                sizes = g.ends[p] - g.starts[p]
                out.append((b, key[0].as_py(), _pack(g.classes[p]), sizes.astype("<u4").tobytes(), low[x].tobytes(), several[x].tobytes(), pack.compress(g.data[ragged(g.starts[p], sizes)].tobytes())))
        columns = list(zip(*out, strict=True)) or [()] * 7
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.binary()] * 5, strict=True)], ["bucket", "gid", "classes", "sizes", "low", "several", "body"])

    def strings(key: tuple, table: pa.Table, wanted: pa.Table) -> pa.Table:
        """(name, gid, low, high) of each whole string of the group's hot classes: the smallest and largest doc that has it."""
        seen: dict[bytes, tuple[int, int]] = {}
        if table.num_rows and wanted.num_rows:
            g = _Group(table)
            g.keep(*told_classes(wanted))
            for name, doc in zip(g.names(), g.docs[g.whole[0]].tolist(), strict=True):
                low, high = seen.get(name, (doc, doc))
                seen[name] = min(low, doc), max(high, doc)
        found = [pa.array(seen, pa.binary()), pa.array(np.full(len(seen), key[0].as_py()), pa.int64()), pa.array([x for x, _ in seen.values()], pa.int64()), pa.array([x for _, x in seen.values()], pa.int64())]
        return pa.table(found, ["name", "gid", "low", "high"])

    def sort(key: tuple, table: pa.Table) -> pa.Table:
        take = lambda name, kind: [np.frombuffer(x, kind) for x in table[name].to_pylist()]
        each = [_unpack(x) for x in table["classes"].to_pylist()]
        sizes = np.concatenate(take("sizes", "<u4")).astype(np.int64)
        low, several = np.concatenate(take("low", "<i8")), np.concatenate(take("several", bool))
        unpack = zstandard.ZstdDecompressor()
        data = np.frombuffer(b"".join(unpack.decompress(x) for x in table["body"].to_pylist()), np.uint8)
        ends = np.cumsum(sizes)
        begin, found = earliest(data, ends - sizes, ends, np.concatenate(each), low)
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        new[begin[:-1]] = True
        heads = np.flatnonzero(new)
        of = np.searchsorted(begin, heads, "right") - 1
        useful = several | (np.minimum.reduceat(found, begin[:-1]) < low)
        counts = np.array([len(x) for x in each])
        edges = np.concatenate([[0], np.cumsum(counts)])
        out = []
        for k, gid in enumerate(table["gid"].to_pylist()):
            a, b = np.searchsorted(of, edges[k]), np.searchsorted(of, edges[k + 1])
            some = np.arange(a, b)[useful[of[a:b]]]
            if len(some):
                out.append((gid, key[0].as_py(), (of[some] - edges[k]).astype("<u4").tobytes(), (heads[some] - begin[of[some]]).astype("<u4").tobytes(), found[heads[some]].tobytes()))
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.binary()] * 3, strict=True)], ["gid", "bucket", "fragment", "first", "earliest"])

    def remove(key: tuple, table: pa.Table, wanted: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"sha": pa.array([], pa.string()), "doc_id": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string()), "kept": pa.array([], pa.string())})
        give_back()
        g = _Group(table)
        cover = np.zeros(len(g.data) + 1, np.int64)
        classes_, wide = told_classes(wanted)
        if len(classes_):
            g.keep(classes_, wide)
            least = {n: d for n, d in zip(wanted["name"].to_pylist(), wanted["least"].to_pylist(), strict=True) if n is not None}
            row, first, last = g.whole
            hit = np.array([least.get(n, d) < d for n, d in zip(g.names(), g.docs[row].tolist(), strict=True)], bool) if least else np.zeros(len(row), bool)
            np.add.at(cover, first[hit], 1)
            np.add.at(cover, last[hit], -1)
            pick, number, _, _ = g.distinct()
            places = _by_bucket(g.classes[pick], buckets)
            runs_of, run_first, run_doc = [], [], []
            for b, fragment, first, doc in zip(*(wanted[c].to_pylist() for c in ("bucket", "fragment", "first", "earliest")), strict=True):
                if fragment is not None:
                    runs_of.append(places[b][np.frombuffer(fragment, "<u4")])
                    run_first.append(np.frombuffer(first, "<u4").astype(np.int64))
                    run_doc.append(np.frombuffer(doc, "<i8"))
            if runs_of:
                of, first, doc = np.concatenate(runs_of), np.concatenate(run_first), np.concatenate(run_doc)
                order = np.lexsort((first, of))
                of, first, doc = of[order], first[order], doc[order]
                windows = (g.ends - g.starts)[pick] - _STRING + 1
                last = np.append(first[1:], 0)
                final = np.append(of[1:] != of[:-1], True)
                last[final] = windows[of[final]]
                low = np.searchsorted(of, number)
                count = np.searchsorted(of, number, "right") - low
                run = ragged(low, count)
                mine = np.repeat(np.arange(len(number)), count)
                hit = doc[run] < g.docs[g.row[mine]]
                run, mine = run[hit], mine[hit]
                np.add.at(cover, g.starts[mine] + first[run], 1)
                np.add.at(cover, g.starts[mine] + last[run] - 1 + _STRING, -1)
        gone = np.cumsum(cover[:-1]) > 0
        out = []
        for i, sha in enumerate(g.shas):
            a, b = g.offsets[i], g.offsets[i + 1]
            own = gone[a:b]
            n = int(own.sum())
            kept = g.data[a:b][~own].tobytes() if n or every else None
            out.append((sha.hex(), int(g.docs[i]), n, int(own[0]) + int((own[1:] & ~own[:-1]).sum()), hashlib.sha256(kept).hexdigest() if n else sha.hex(), None if kept is None else kept.decode("utf-8", "ignore")))
        columns = list(zip(*out, strict=True))
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["sha", "doc_id", "n_removed", "n_spans", "kept_sha256", "kept"])

    own = dealt.groupBy("gid").applyInArrow(classes, "bucket long, gid long, classes binary, shared binary")
    wanted = durable(own.repartition(parts, "bucket").groupBy("bucket").applyInArrow(answer, "gid long, classes binary, hot binary, any_hot boolean"))
    del own
    let_go(docs.sparkSession)
    pieces = dealt.groupBy("gid").cogroup(wanted.groupBy("gid")).applyInArrow(cut, "bucket long, gid long, classes binary, sizes binary, low binary, several binary, body binary")
    runs = pieces.repartition(parts, "bucket").groupBy("bucket").applyInArrow(sort, "gid long, bucket long, fragment binary, first binary, earliest binary")
    answers = [wanted.select("gid", "classes", "hot"), runs]
    asked = wanted.where("any_hot")
    if not asked.isEmpty():
        whole = durable(dealt.join(asked.select("gid").distinct(), "gid", "left_semi").groupBy("gid").cogroup(asked.groupBy("gid")).applyInArrow(strings, "name binary, gid long, low long, high long"))
        least = durable(whole.groupBy("name").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("name", "least"))
        answers.append(whole.join(least.hint("merge"), "name").where("least < high").select("gid", "name", "least"))
    kinds = {"classes": "binary", "hot": "binary", "bucket": "long", "fragment": "binary", "first": "binary", "earliest": "binary", "name": "binary", "least": "long"}
    filled = [a.select("gid", *(F.col(c) if c in a.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items())) for a in answers]
    told = reduce(DataFrame.unionByName, filled)
    return dealt.groupBy("gid").cogroup(told.groupBy("gid")).applyInArrow(remove, "sha string, doc_id long, n_removed long, n_spans long, kept_sha256 string, kept string")


_EMPTY = hashlib.sha256(b"").hexdigest()


def _resolved(docs: DataFrame, *keep: str, hot: int = _HOT) -> DataFrame:
    """Rows (*keep, _id, _sha, _n) with what was removed from their text; doc_id is the smallest that has the same text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, F.col("doc_id").cast("long").alias("_id"), F.sha2(text, 256).alias("_sha"), F.octet_length(text).cast("long").alias("_n"))
    return rows.join(removed_spans(docs.select("doc_id", "text"), hot).withColumnRenamed("sha", "_sha").withColumnRenamed("doc_id", "_least"), "_sha", "left")


def dedup_substrings(docs: DataFrame, hot: int = _HOT) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id; strings are compared in the
    input, overlaps count, matches never cross documents. n_spans counts maximal removed runs; kept_sha256 is of the rest.

    A null text is empty; texts under 50 bytes keep all. Rows with equal doc_ids don't remove from each other. A null
    doc_id is neither smaller nor larger than any: such rows keep all their bytes. Repeated rows each get a row. Other columns are
    not read. An empty table gives an empty result.
    """
    rows = _resolved(docs, hot=hot)
    all_ = (F.col("_n") >= _STRING) & (F.col("_id") > F.col("_least"))
    some = F.col("_id").isNotNull() & F.col("n_removed").isNotNull()
    pick = lambda whole, part, none: F.when(all_, whole).when(some, part).otherwise(none)
    return rows.select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_bytes"), pick(F.col("_n"), F.col("n_removed"), F.lit(0).cast("long")).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("n_spans"), F.lit(0).cast("long")).alias("n_spans"), pick(F.lit(_EMPTY), F.col("kept_sha256"), F.col("_sha")).alias("kept_sha256"),
    )


def drop_repeated_substrings(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the texts, without documents of which no word is left.

    n_chars, where there is such a column, counts the code points of the new text. A character of which only some bytes went is
    dropped. Texts from which nothing is removed stay as they are, null and empty ones included.

    Rows with equal doc_ids don't cut each other and rows without a doc_id aren't cut; so repeated rows all stay. An empty table stays empty; extra columns
    of any name are carried along.
    """
    columns = docs.columns
    text = F.coalesce("text", F.lit(""))
    others = [F.col(f"`{c}`") for c in columns if c != "text"]
    # texts of 50 bytes or more come back from the groups that they were dealt to, so that they don't travel with their rows as well
    stays = F.col("doc_id").isNull() | (F.octet_length(text) < _STRING)
    rows = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.when(stays, F.col("text")).alias("_own"), stays.alias("_stays"), F.sha2(text, 256).alias("_sha"))
    found = removed_spans(docs.select("doc_id", "text"), every=True).select(F.col("sha").alias("_sha"), F.col("doc_id").alias("_least"), "n_removed", "kept")
    rows = rows.join(found, "_sha", "left")
    left = rows.where(F.col("_stays") | ((F.col("_id") <= F.col("_least")) & ((F.col("n_removed") == 0) | F.col("kept").rlike(WORD))))
    out = left.select(*(F.when(F.col("_stays"), F.col("_own")).otherwise(F.col("kept")).alias("text") if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
