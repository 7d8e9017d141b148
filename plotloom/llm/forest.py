"""Nearest neighbours by a forest of random-projection trees, one queue over all trees, and exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Search budgets tried in turn, as shares of all rows.
_SHARES = (*np.geomspace(0.0005, 0.95, 64).tolist(), 1.0)
#: Queries whose queues are held side by side.
_SIDE = 64


@dataclass(frozen=True)
class Forest:
    """Full binary trees. A level of a tree projects on one random direction; each node cuts at its sample's median."""

    directions: np.ndarray  # trees, depth, dimensions
    cuts: np.ndarray  # trees, 2 ** depth - 1, by level
    share: float = 1.0  # of the rows: the leaves searched hold this share of them
    weights: np.ndarray | None = None  # trees, leaves: the share of the sample in each leaf

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, leaf: int, seed: int) -> Forest:
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        depth = max(1, int(np.ceil(np.log2(max(len(sample), 2) / leaf))))
        directions = rng.standard_normal((trees, depth, dims))
        directions /= np.linalg.norm(directions, axis=2, keepdims=True)
        cuts = np.zeros((trees, (1 << depth) - 1))
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for d in range(depth):
                at = sample @ directions[t, d]
                order = np.lexsort((at, node))
                bounds = np.searchsorted(node[order], np.arange((1 << d) + 1))
                for k in range(1 << d):
                    if bounds[k + 1] > bounds[k]:
                        cuts[t, (1 << d) - 1 + k] = np.median(at[order[bounds[k] : bounds[k + 1]]])
                node = 2 * node + (at > cuts[t, (1 << d) - 1 + node])
        out = cls(directions, cuts)
        leaves = out.leaves(sample)
        weights = np.stack([np.bincount(x, minlength=1 << depth) for x in leaves]) / max(1, len(sample))
        return cls(directions, cuts, 1.0, weights)

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """(trees, rows): each row's leaf in each tree."""
        out = np.zeros((len(self.directions), len(rows)), np.int64)
        for t, levels in enumerate(self.directions):
            at = rows @ levels.T
            for d in range(self.depth):
                out[t] = 2 * out[t] + (at[:, d] > self.cuts[t, (1 << d) - 1 + out[t]])
        return out

    def search(self, query: np.ndarray, share: float | None = None) -> list[tuple[int, int]]:
        """The leaves (tree, leaf) to search, nearest first by the squared distances to the cuts crossed on the way.

        Leaves are taken from the one queue until those of the fullest tree hold the wanted share of the rows; rows found
        in several trees count once that way. ``bounds`` says the same for many queries at once.
        """
        share = self.share if share is None else share
        at = np.einsum("tds,s->td", self.directions, query)
        queue = [(0.0, t, 0, 0) for t in range(len(self.directions))]
        held = np.zeros(len(self.directions))
        out = []
        while queue and held.max() < share - 1e-9:
            far, t, d, k = heapq.heappop(queue)
            while d < self.depth:
                margin = at[t, d] - self.cuts[t, (1 << d) - 1 + k]
                side = int(margin > 0)
                heapq.heappush(queue, (far + margin * margin, t, d + 1, 2 * k + 1 - side))
                k, d = 2 * k + side, d + 1
            out.append((t, k))
            held[t] += self.weights[t, k]
        return out

    def keys(self, queries: np.ndarray) -> np.ndarray:
        """(queries, trees, leaves): each leaf's key in a query's queue."""
        at = np.einsum("tds,qs->qtd", self.directions, queries)
        out = np.zeros((len(queries), len(self.directions), 1))
        for d in range(self.depth):
            margin = at[:, :, d, None] - self.cuts[None, :, (1 << d) - 1 : (2 << d) - 1]
            with np.errstate(over="ignore"):
                crossed, right = out + margin * margin, margin > 0
            out = np.stack([np.where(right, crossed, out), np.where(right, out, crossed)], 3).reshape(len(queries), len(self.directions), -1)
        return out

    def queued(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each tree's keys in the order of the queue, and the share of the rows that its leaves hold up to there."""
        order = keys.argsort(2, kind="stable")
        return np.take_along_axis(keys, order, 2), np.cumsum(np.take_along_axis(np.broadcast_to(self.weights, keys.shape), order, 2), 2)

    def bounds(self, keys: np.ndarray, share: float | None = None, queued: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The key at which each query's queue stops: leaves come in the order of their keys, so those up to it are searched."""
        share = self.share if share is None else share
        sorted_, held = self.queued(keys) if queued is None else queued
        last = np.minimum((held < share - 1e-9).sum(2, keepdims=True), keys.shape[2] - 1)
        return np.take_along_axis(sorted_, last, 2)[:, :, 0].min(1)

    def calibrated(self, sample: np.ndarray, wanted: float, k: int, queries: int, seed: int) -> Forest:
        """With the smallest search share that reaches the wanted recall on queries drawn from the sample."""
        rng = np.random.default_rng(seed)
        picked = rng.choice(len(sample), min(queries, len(sample)), replace=False)
        leaves, trees = self.leaves(sample), np.arange(len(self.directions))[:, None]
        keys = self.keys(sample[picked])
        nearest = []  # of each true neighbour, the key of the nearest of its leaves
        for i, own in zip(picked, keys, strict=True):
            d = distances(sample, sample[i])
            d[i] = np.inf
            truth = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
            nearest.append(own[trees, leaves[:, truth]].min(0))
        total, queued = sum(map(len, nearest)), self.queued(keys)
        share = 1.0
        for share in _SHARES:
            if sum((n <= b).sum() for n, b in zip(nearest, self.bounds(keys, share, queued), strict=True)) >= wanted * total:
                break
        return Forest(self.directions, self.cuts, share, self.weights)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _flat(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in doubles. Where squares leave the range of a double, they are taken of shares of the largest difference."""
    gap = rows.astype(np.float64) - query
    with np.errstate(over="ignore"):
        out = np.sqrt((gap * gap).sum(1))
        odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-140))
    if len(odd):
        half = np.abs(rows[odd].astype(np.float64) / 2 - query / 2)  # halves, as a difference may be too large itself
        most = half.max(1, initial=0.0)
        with np.errstate(over="ignore"):
            out[odd] = np.where(most > 0, 2 * (most * np.sqrt(((half / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1))), 0.0)
    return out


def _best(query: np.ndarray, base: np.ndarray, ids: np.ndarray, hit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the ``k`` nearest of the rows ``hit``, in the order of ascending ids; of a vec_id with several vectors, the nearest counts."""
    d = np.concatenate([np.zeros(0), *(distances(base[hit[i : i + 8192]], query) for i in range(0, len(hit), 8192))])
    own = ids[hit]
    if len(own) and (own[1:] == own[:-1]).any():
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        d, own = np.minimum.reduceat(d, begin), own[begin]
    if len(d) > k:
        close = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        d, own = d[close], own[close]
    order = np.argsort(d, kind="stable")[:k]
    return d[order], own[order]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that repeat an earlier row of their batch go, so that one row's many copies don't travel."""
    for b in batches:
        if b.num_rows and pc.count_distinct(b.column("vec_id")).as_py() < b.num_rows:
            rows = pa.table({"id": b.column("vec_id"), "hash": b.column("hash"), "at": pa.array(np.arange(b.num_rows))})
            b = b.take(rows.group_by(["id", "hash"]).aggregate([("at", "min")])["at_min"].combine_chunks())
        yield b


def nearest_neighbours(
    rows: DataFrame, every: int = 100, k: int = 10, trees: int = 12, leaf: int = 48, most_sample: int = 32768, recall: float = 0.96,
    block_bytes: int = 128 << 20, most_queries: int = 524288, seed: int = 11,
) -> DataFrame:
    """The ``k`` nearest found for each query of (vec_id, embedding): query_id, rank (from 1), vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all rows but the query's own. score is the
    Euclidean distance of the original vectors in double precision; nearest first, ties to the smaller vec_id. Leaves searched hold
    4 * ``k`` rows of the table at least, and small tables are searched whole, so with ``k`` candidates or fewer all come back.

    Vectors that are null, empty, all zero or hold a null or non-finite component take no part, nor do rows with a null
    vec_id or with another length than the most common one (the smaller, if tied). Rows with equal vec_id and vector count once.
    Other columns are not read. An empty table gives an empty result.

    The forest is fitted on at most ``most_sample`` distinct vectors, picked by hash, and the search share is
    calibrated on them for ``recall`` (on data without structure it may be large). Every row is indexed and travels once: to
    one of the blocks of about ``block_bytes`` of vectors, dealt by hash, where its leaf in every tree is found. A query goes to each
    block with the key at which its queue stops; the block reranks exactly the rows whose leaf in some tree has
    a key up to that, and gives back its ``k`` best. Over ``most_queries`` queries, the queries come in blocks too.
    """
    spark = rows.sparkSession
    source = rows.schema["embedding"].dataType
    kind = "array<float>" if isinstance(source, T.ArrayType) and isinstance(source.elementType, T.FloatType) else "array<double>"
    numbers = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = numbers.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where((F.size("v") > 0) & ~bad).where(F.exists("v", lambda x: x != 0))
    asking = F.col("vec_id") % every == 0
    sizes = valid.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.count_if(asking).alias("asked")).orderBy(F.desc("rows"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dims, n = sizes[0].n, sizes[0].rows
    valid = valid.where(F.size("v") == dims).withColumn("hash", F.xxhash64("v"))
    drawn = valid.where(F.pmod("hash", F.lit(-(-n // most_sample))) == 0).groupBy("hash").agg(F.first("v").alias("v")).toArrow().sort_by("hash").slice(0, most_sample)
    if not drawn.num_rows:
        drawn = valid.limit(most_sample).select("v").toArrow()
    forest = Forest.fit(np.ascontiguousarray(_vectors(drawn["v"].combine_chunks())), trees, leaf, seed)
    forest = forest.calibrated(_vectors(drawn["v"].combine_chunks()), recall, k, 128, seed)
    forest = replace(forest, share=max(forest.share, min(1.0, max(leaf, 4 * k) / n)))
    shared = spark.sparkContext.broadcast(forest)  # at most 2 * most_sample / leaf nodes a tree
    width = 4 if kind == "array<float>" else 8
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-n * dims * width // block_bytes))
    rounds = max(1, -(-sizes[0].asked // most_queries))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for at in range(0, b.num_rows, _SIDE):
                some = b.slice(at, _SIDE)
                stop = own.bounds(own.keys(_vectors(some.column("v"))))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("vec_id", "v", "hash")), pa.array(stop)], ["query_id", "v", "hash", "stop"])

    def rerank(found: pa.Table, asked: pa.Table) -> pa.Table:
        own, out = shared.value, []
        if found.num_rows and asked.num_rows:
            order = np.argsort(found["vec_id"].to_numpy(), kind="stable")
            ids = found["vec_id"].to_numpy()[order]
            base = _flat(found["v"].combine_chunks(), dims)[order]
            leaves = np.concatenate([own.leaves(base[i : i + 8192].astype(np.float64)).astype(np.int32) for i in range(0, len(base), 8192)], 1)
            names, stops = asked["query_id"].to_numpy(), asked["stop"].to_numpy()
            vectors = asked["v"].combine_chunks()
            for at in range(0, len(names), _SIDE):
                some = _vectors(vectors.slice(at, _SIDE))
                near = own.keys(some) <= stops[at : at + _SIDE, None, None]
                for q, query, opened in zip(names[at : at + _SIDE], some, near, strict=True):
                    hit = opened[0][leaves[0]]
                    for t in range(1, len(leaves)):
                        hit |= opened[t][leaves[t]]
                    hit &= ids != q
                    out.append((q, *_best(query, base, ids, np.flatnonzero(hit), k)))
        return pa.table(
            [pa.array(np.repeat([q for q, _, _ in out], [len(d) for _, d, _ in out]).astype(np.int64)), pa.array(np.concatenate([[], *(d for _, d, _ in out)])), pa.array(np.concatenate([np.zeros(0, np.int64), *(i for _, _, i in out)]))],
            ["query_id", "score", "vec_id"],
        )

    part = F.pmod(F.xxhash64("vec_id", "hash"), F.lit(blocks))
    turn = F.pmod(F.xxhash64("hash", "vec_id"), F.lit(rounds))
    key = lambda block, turn: (turn * F.lit(blocks) + block).cast("long").alias("key")
    single = valid.mapInArrow(_once, f"vec_id long, v {kind}, hash long")
    indexed = single.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).select(key(part, F.col("turn")), "vec_id", "v")
    queries = valid.where(asking).mapInArrow(_once, f"vec_id long, v {kind}, hash long").mapInArrow(probe, f"query_id long, v {kind}, hash long, stop double")
    asked = queries.withColumnRenamed("query_id", "vec_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(key(F.col("block"), turn), F.col("vec_id").alias("query_id"), "v", "stop")
    pairs = indexed.groupBy("key").cogroup(asked.groupBy("key")).applyInArrow(rerank, "query_id long, score double, vec_id long")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
