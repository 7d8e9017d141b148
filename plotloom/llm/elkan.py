"""Centroid clustering with the bounds of Elkan, exact on integers."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotloom.llm.common import durable, durable_by, give_back, let_go

#: Distances are rounded up or down by this much, far more than the rounding of a square root, a sum or a conversion.
_UP, _DOWN = 1 + 1e-14, 1 - 1e-14
#: Vectors of integers up to this size have squared distances that fit 64 bits; others are handled as Python's integers of any length.
NARROW = 1 << 25
_LONG = 1 << 63
_BIG = 1.7e308


def root(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots of exact integers as doubles, never below the true root if ``up``, else never above."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64)) * (_UP if up else _DOWN)

    def one(x: int) -> float:
        whole = math.isqrt(x) + (1 if up else 0)
        return (math.inf if up else _BIG) if whole > 10**308 else float(whole) * (_UP if up else _DOWN)

    return np.array([one(int(x)) for x in squares.ravel()], np.float64).reshape(squares.shape)


def squared(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``points`` to a center, or row by row."""
    gap = points - center
    return (gap * gap).sum(1)


@dataclass
class Bounds:
    """Of each vector: its cluster, an upper bound of the distance to that centroid, and a lower bound for each centroid."""

    cluster: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    @classmethod
    def none(cls, n: int, k: int) -> Bounds:
        return cls(np.zeros(n, np.int16), np.full(n, np.inf), np.zeros((n, k)))


def assign(points: np.ndarray, centers: np.ndarray, bounds: Bounds) -> tuple[Bounds, np.ndarray, int]:
    """(new bounds, exact squared distances where they were needed, else -1, number of distances calculated).

    A centroid is skipped only if a bound says that it is strictly farther than the vector's own, so that a tie always comes to
    the comparison of exact integers, where the smaller number wins.
    """
    k = len(centers)
    cluster, upper, lower = bounds.cluster.copy(), bounds.upper.copy(), bounds.lower.copy()
    between = np.stack([root(squared(centers, c), up=False) for c in centers]) / 2 * _DOWN
    apart = between + np.where(np.eye(k, dtype=bool), np.inf, 0)
    own = np.full(len(points), -1, points.dtype)
    calculated = 0
    open_ = upper >= apart.min(1)[cluster] if k > 1 else np.zeros(len(points), bool)
    for j in range(k):
        at = np.flatnonzero(open_ & (cluster != j) & (upper >= lower[:, j]) & (upper >= between[cluster, j]))
        if not len(at):
            continue
        fresh = at[own[at] == -1]
        if len(fresh):  # the upper bound becomes the distance, and may skip what the old one could not
            own[fresh] = squared(points[fresh], centers[cluster[fresh]])
            upper[fresh] = root(own[fresh], up=True)
            lower[fresh, cluster[fresh]] = root(own[fresh], up=False)
            calculated += len(fresh)
            at = at[(upper[at] >= lower[at, j]) & (upper[at] >= between[cluster[at], j])]
        if not len(at):
            continue
        there = squared(points[at], centers[j])
        calculated += len(at)
        lower[at, j] = root(there, up=False)
        nearer = (there < own[at]) | ((there == own[at]) & (j < cluster[at]))
        to = at[nearer]
        own[to], cluster[to], upper[to] = there[nearer], j, root(there[nearer], up=True)
    return Bounds(cluster, upper, lower), own, calculated


def moved(bounds: Bounds, drift: np.ndarray) -> Bounds:
    """The bounds after each centroid moved by at most ``drift``."""
    upper = (bounds.upper + drift[bounds.cluster]) * _UP
    return Bounds(bounds.cluster, upper, np.maximum(0, (bounds.lower - drift) * _DOWN - drift * 1e-13))


# --- blocks of vectors in a column ---------------------------------------------------------------

_BLOCK = "block long, ids binary, missing binary, wide boolean, vectors binary"
_STATE = "block long, state binary"


def _pack(points: list[list[int]]) -> tuple[bool, bytes]:
    if all(-NARROW <= x <= NARROW for p in points for x in p):
        return False, np.array(points, np.int32).tobytes()
    return True, json.dumps(points).encode()


def _unpack(wide: bool, data: bytes, dimensions: int, centers: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centers as arrays in which squared distances are exact."""
    points = np.array(json.loads(data), object) if wide else np.frombuffer(data, np.int32).reshape(-1, dimensions).astype(np.int64)
    kind = object if wide or any(not -NARROW <= x <= NARROW for c in centers for x in c) else np.int64
    return points.astype(kind), np.array(centers, kind).reshape(len(centers), dimensions)


def _dump(b: Bounds) -> bytes:
    with np.errstate(over="ignore"):  # 4 bytes a bound, rounded away from the truth
        return b.cluster.tobytes() + np.nextafter(b.upper.astype(np.float32), np.float32(np.inf)).tobytes() + np.nextafter(np.minimum(b.lower, 3e38).astype(np.float32), np.float32(0)).tobytes()


def _load(data: bytes, k: int) -> Bounds:
    n = len(data) // (6 + 4 * k)
    upper = np.frombuffer(data, np.float32, n, 2 * n).astype(np.float64)
    return Bounds(np.frombuffer(data, np.int16, n), upper, np.frombuffer(data, np.float32, n * k, 6 * n).astype(np.float64).reshape(n, k))


def _integers(values: list[float]) -> list[int]:
    """floor(1024 * x) of doubles, exactly, also where 1024 * x is no double any more."""
    return [math.floor(x * 1024) if abs(x) < 1e300 else int(x) * 1024 for x in values]


def _kept(vectors: DataFrame, dimensions: int) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dimensions) & finite)


def _blocks(kept: DataFrame, rows: int) -> DataFrame:
    """Vectors as blocks of up to ``rows`` of a partition, in order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                ids = part.column("vec_id")
                narrow = np.floor(np.asarray(part.column("x").flatten(), np.float64) * 1024).reshape(part.num_rows, -1)
                wide, data = (False, narrow.astype(np.int32).tobytes()) if np.abs(narrow).max() <= NARROW else _pack([_integers(v) for v in part.column("x").to_pylist()])
                yield pa.RecordBatch.from_pydict({"ids": [ids.fill_null(0).to_numpy().tobytes()], "missing": [ids.is_null().to_numpy(False).tobytes()], "wide": [wide], "vectors": [data]})
        give_back()

    return kept.mapInArrow(pack, _BLOCK.replace("block long, ", "")).select(F.monotonically_increasing_id().alias("block"), "*")


def _sums(parts: DataFrame) -> dict[int, list]:
    """Adds (cluster, payload) rows, JSON of a count, sums and a distance of any length: in groups of tasks first, so that the driver gets at most 64 rows a cluster."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _into(total, c, json.loads(p))
        if total:
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(total, pa.int32()), "payload": [json.dumps(v) for v in total.values()]})

    out: dict[int, list] = {}
    groups = min(64, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grouped = parts.withColumn("g", F.spark_partition_id() % groups).repartition(groups, "g").select("cluster", "payload")
    for r in grouped.mapInArrow(add, "cluster int, payload string").collect():
        _into(out, r.cluster, json.loads(r.payload))
    return out


def _into(total: dict[int, list], cluster: int, more: list) -> None:
    was = total.get(cluster)
    total[cluster] = more if was is None else [was[0] + more[0], [a + b for a, b in zip(was[1], more[1], strict=True)], was[2] + more[2]]


def _long(x: int) -> int | None:
    return x if x < _LONG else None


def cluster_vectors(vectors: DataFrame, clusters: int = 8, rounds: int = 10, seed: int = 3, dimensions: int = 64, block: int = 1024) -> DataFrame:
    """One row per kept vector of (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and size.

    Kept are vectors with ``dimensions`` components, none null or non-finite; x becomes floor(1024 * x). The ``clusters`` vectors with the
    smallest sha256 of ``seed:vec_id`` start as centroids (equal hashes: by their components; all vectors, if fewer). Each of ``rounds``
    rounds assigns every vector to the nearest centroid, ties to the smaller number, and moves non-empty centroids to floor(sum / count).

    Vectors lie once in a durable table of blocks, dealt by block. A round joins the blocks with their bounds (an upper one and one for each
    centroid, 6 + 4 * clusters bytes a vector), which alone are written anew; nothing of a vector is moved again. Sums are added in tasks, then in 64
    groups; the driver holds the centroids only. Bounds are rounded away from the truth and skip a centroid only where it is strictly farther, so
    the result is that of calculating all distances; distances are integers of any length.

    A null vec_id stays null, its hash is that of no digits; repeated rows and ids are separate vectors; components too large for 64-bit distances
    are exact as well, with a null for a distance or inertia that no long holds; other columns are not read; empty tables, or none kept, give an empty result.
    """
    spark = vectors.sparkSession
    kept = _kept(vectors, dimensions)
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    centers = [_integers(r.x) for r in first]
    k = len(centers)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, size long"
    if not k:
        return spark.createDataFrame([], out)
    blocks = durable_by(_blocks(kept, block), int(spark.conf.get("spark.sql.shuffle.partitions")), "block")

    def step(batches: Iterator[pa.RecordBatch], centers: list[list[int]], drift: list[float] | None) -> Iterator[tuple]:
        for b in batches:
            for i in range(b.num_rows):
                points, at = _unpack(b.column("wide")[i].as_py(), b.column("vectors")[i].as_py(), dimensions, centers)
                state = b.column("state")[i].as_py()
                before = Bounds.none(len(points), k) if state is None else moved(_load(state, k), np.array(drift))
                yield b, i, points, at, *assign(points, at, before)

    def round_of(state: DataFrame | None, drift: list[float] | None) -> DataFrame:
        now = [list(c) for c in centers]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for b, i, points, _, bounds, _, _ in step(batches, now, drift):
                for c in np.unique(bounds.cluster):
                    own = points[bounds.cluster == c]
                    _into(total, int(c), [len(own), [int(x) for x in own.sum(0)], 0])
                yield pa.RecordBatch.from_pydict({"block": b.column("block").slice(i, 1), "state": [_dump(bounds)], "cluster": pa.nulls(1, pa.int32()), "payload": pa.nulls(1, pa.string())})
            n = len(total)
            if n:
                yield pa.RecordBatch.from_pydict({"block": pa.nulls(n, pa.int64()), "state": pa.nulls(n, pa.binary()), "cluster": pa.array(total, pa.int32()), "payload": [json.dumps(v) for v in total.values()]})
            give_back()

        return durable(_with_state(blocks, state).mapInArrow(run, f"{_STATE}, cluster int, payload string"))

    state, drift = None, None
    for _ in range(rounds):
        state = round_of(state, drift)
        total = _sums(state.where("cluster IS NOT NULL").select("cluster", "payload"))
        old = centers
        centers = [[s // total[c][0] for s in total[c][1]] if c in total else old[c] for c in range(k)]
        drift = [float(root(np.array([sum((a - b) ** 2 for a, b in zip(x, y, strict=True))], object), up=True)[0]) for x, y in zip(old, centers, strict=True)]
        state = state.where("block IS NOT NULL").select("block", "state")
        let_go(spark)
    final = [list(c) for c in centers]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, points, at, bounds, own, _ in step(batches, final, drift):
            rest = np.flatnonzero(own == -1)
            own[rest] = squared(points[rest], at[bounds.cluster[rest]])
            ids = pa.array(np.frombuffer(b.column("ids")[i].as_py(), np.int64), mask=np.frombuffer(b.column("missing")[i].as_py(), bool))
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": pa.array(bounds.cluster, pa.int32()), "distance": pa.array([str(int(x)) for x in own])})
        give_back()

    placed = durable(_with_state(blocks, state).mapInArrow(last, "vec_id long, cluster int, distance string"))

    def inertia(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for c, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _into(total, c, [1, [], int(d)])
        if total:
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(total, pa.int32()), "payload": [json.dumps(v) for v in total.values()]})

    total = _sums(placed.select("cluster", "distance").mapInArrow(inertia, "cluster int, payload string"))
    whole = sum(v[2] for v in total.values())
    rows = [(c, _long(v[2]), _long(whole), ",".join(map(str, final[c])), v[0]) for c, v in total.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid string, size long")
    fits = F.when((F.length("distance") < 19) | ((F.length("distance") == 19) & (F.col("distance") <= str(_LONG - 1))), F.col("distance").cast("long"))
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", fits.alias("distance"), "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"), "size")


def _with_state(blocks: DataFrame, state: DataFrame | None) -> DataFrame:
    if state is None:
        return blocks.withColumn("state", F.lit(None).cast("binary"))
    return blocks.join(state.hint("merge"), "block")
