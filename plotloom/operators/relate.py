"""Joins, orderings and samples that stories and questions need."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotloom.operators.prefix import running
from plotloom.sources.scratch import stored


def interval_join(spans: DataFrame, cues: DataFrame, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Overlaps of spans (s_start, s_end) with cues (c_start, c_end), half open, as an equi-join on buckets of ``width``.

    Both sides are copied to the buckets they touch; a pair comes back from the bucket of the later start only.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(a), F.col(b)) / width)))
    left = spans.withColumn("_b", buckets("s_start", "s_end"))
    right = cues.withColumn("_b", buckets("c_start", "c_end"))
    hit = (F.col("c_start") < F.col("s_end")) & (F.col("c_end") > F.col("s_start")) & (F.floor(F.greatest("s_start", "c_start") / width) == F.col("_b"))
    return left.join(right, [*keys, "_b"]).where(hit).drop("_b")


def first_others(rows: DataFrame, group: Sequence[str], key: str, k: int = 3) -> DataFrame:
    """Adds others: the ``k`` first keys of the row's group besides its own. The group's k + 1 first are enough, so pairs are never made."""
    order = Window.partitionBy(*group).orderBy(key)
    first = rows.select(*group, key).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k + 1)
    first = first.groupBy(*group).agg(F.array_sort(F.collect_list(key)).alias("_first"))
    return rows.join(first, list(group)).withColumn("others", F.slice(F.filter("_first", lambda x: x != F.col(key)), 1, k)).drop("_first")


def keep_first(rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_by(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def _best(own: pd.DataFrame, some: pd.DataFrame, k: int, skip_own: bool = True) -> list[tuple]:
    """(query_id, doc_id, score) of the ``k`` best of own (doc_id, v) for each of some (query_id, v), ties to the smaller doc_id, by products of matrices.

    Vectors without a length score null and come last; one of another length than the query's takes no part.
    """
    out: list[tuple] = []
    if not len(own) or not len(some):
        return out
    own = own.sort_values("doc_id", kind="stable")
    ids, wide = own["doc_id"].to_numpy(), own["v"].map(len).to_numpy()
    for size, few in some.groupby(some["v"].map(len)):
        fit = np.flatnonzero(wide == size)
        if not len(fit) or not size:
            continue
        base, asked, names = np.stack(own["v"].to_numpy()[fit]), np.stack(few["v"].to_numpy()), few["query_id"].to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            base = base / np.sqrt((base * base).sum(1))[:, None]
            asked = asked / np.sqrt((asked * asked).sum(1))[:, None]
        step = max(1, (1 << 22) // len(fit))  # of the scores, some 32 MB at a time
        for at in range(0, len(names), step):
            score = asked[at : at + step] @ base.T
            score[np.isnan(score)] = -np.inf
            for name, vector, line in zip(names[at : at + step], asked[at : at + step], score, strict=True):
                order = np.flatnonzero(ids[fit] != name) if skip_own else np.arange(len(fit))
                if len(order) > k:
                    bar = np.partition(line[order], len(order) - k)[len(order) - k]
                    order = order[line[order] >= bar - 1e-12]
                # a product's last bits hang on a row's place in the matrix, so equal vectors would not tie: sums from the front don't
                exact = np.where(line[order] == -np.inf, -np.inf, (base[order] * vector).cumsum(1)[:, -1])
                best = np.argsort(-exact, kind="stable")[:k]
                out.extend((name, ids[fit[i]], None if s == -np.inf else float(s)) for i, s in zip(order[best], exact[best], strict=True))
    return out


def top_cosine(queries: DataFrame, docs: DataFrame, k: int, asked: int = 4096, held: int = 65536) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` best of docs (doc_id, v) for each query (query_id, v), ties to the smaller doc_id.

    Both sides are dealt to blocks, of about ``asked`` queries and ``held`` documents. A pair of blocks meets in one task, as a product of two
    matrices, and only each query's best ``k`` leave it, so that pairs are never rows and nothing is broadcast. Vectors without a length score null
    and come last; one of another length than the query's takes no part. Every pair of blocks meets: see pruned_cosine. Both sides are counted first.
    """
    n, m = docs.count(), queries.count()
    rows, turns = max(1, -(-n // held)), max(1, -(-m // asked))
    block = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts))
    spread = lambda parts, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias(name)  # long as ``block``: other types would be dealt to other partitions
    left = docs.select("doc_id", F.transform("v", lambda x: x.cast("double")).alias("v"), block("doc_id", rows).alias("row"), spread(turns, "turn"))
    right = queries.select("query_id", F.transform("v", lambda x: x.cast("double")).alias("v"), block("query_id", turns).alias("turn"), spread(rows, "row"))
    return _ranked(_met(left, right, ["row", "turn"], k), k)


def _met(left: DataFrame, right: DataFrame, by: Sequence[str], k: int, skip_own: bool = True) -> DataFrame:
    """(query_id, doc_id, score): each group's ``k`` best of left (doc_id, v) for each of right (query_id, v)."""

    def best(own: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_best(own, some, k, skip_own), columns=["query_id", "doc_id", "score"])

    kinds = dict(right.dtypes)["query_id"], dict(left.dtypes)["doc_id"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(best, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pruned_cosine(queries: DataFrame, docs: DataFrame, k: int, held: int = 4096, asked: int = 4096, sample: int = 20_000) -> tuple[DataFrame, dict[str, int]]:
    """The rows of ``top_cosine``, of which a query meets only blocks that can hold one of its ``k`` best; and {pairs, met}: pairs of query and block, in all and met.

    Documents lie in blocks around centres, which are drawn by hash; a block of more than ``held`` is parted again. On the unit sphere a block has a centre and a
    radius, so the distance of a query to the centre bounds the cosine with all that lies in it. A query first meets the blocks with the best bounds
    that hold more than ``k`` documents together; its k-th best there is a bar, and of the others only blocks whose bound reaches it are met.
    The result is exact: bounds are widened by more than they can be rounded. A query without a length, or with fewer than ``k`` so far, meets all.

    The blocks' centres, a row for about ``held`` documents, go to every task that bounds queries; both tables, and what the first round
    found, are stored in the shared folder.
    """
    spark = docs.sparkSession
    unit = lambda df, name: df.select(name, F.transform("v", lambda x: x.cast("double")).alias("v"))
    own, some = stored(unit(docs, "doc_id"), "vectors"), stored(unit(queries, "query_id"), "queries")
    n = own.count()
    number = max(1, -(-2 * n // held))
    rate = max(1, n // max(1, min(sample, 4 * number)))
    drawn = [np.array(r.v) for r in own.where(F.pmod(F.xxhash64("doc_id"), F.lit(rate)) == 0).where(F.size("v") > 0).orderBy(F.xxhash64(F.lit(7), "doc_id")).limit(min(sample, number)).collect()]
    centres: dict[int, np.ndarray] = {}
    for size in {len(v) for v in drawn}:
        some_ = np.stack([v for v in drawn if len(v) == size])
        length = np.sqrt((some_ * some_).sum(1))
        centres[size] = some_[length > 0] / length[length > 0][:, None]
    shared = spark.sparkContext.broadcast(centres)  # at most ``sample`` vectors

    def near(vs: pd.Series) -> pd.Series:
        out = np.zeros(len(vs), np.int64)
        for size, at in vs.groupby(vs.map(len)).groups.items():
            c = shared.value.get(size)
            if c is not None and len(c):
                place = vs.index.get_indexer(at)
                x = np.stack(vs.to_numpy()[place])
                length = np.sqrt((x * x).sum(1))
                cell = 1 + (x @ c.T).argmax(1)
                out[place] = np.where(length > 0, cell, 0)
        return pd.Series(out)

    cell = F.pandas_udf(near, "long")
    celled = own.withColumn("cell", cell("v")).withColumn("wide", F.size("v"))
    sizes = celled.groupBy("wide", "cell").agg(F.ceil(F.count("*") / held).alias("parts"))
    laid = celled.join(sizes, ["wide", "cell"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).withColumn("block", F.concat_ws("/", "wide", "cell", "part")).drop("parts", "part")
    laid = stored(laid, "blocks")

    def summary(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["v"].to_numpy()) if len(frame["v"].iloc[0]) else np.zeros((len(frame), 0))
        length = np.sqrt((x * x).sum(1))
        whole = bool((length > 0).all()) and x.shape[1] > 0
        x = x / length[:, None] if whole else x
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1)).max()) * (1 + 1e-9) + 1e-9 if whole else float("inf")
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "wide": [x.shape[1]], "n": [len(frame)], "centre": [centre], "radius": [radius]})

    blocks = laid.select("block", "v").groupBy("block").applyInPandas(summary, "block string, wide long, n long, centre array<double>, radius double").collect()  # a row for about ``held`` documents
    by_size: dict[int, tuple] = {}
    for size in {r.wide for r in blocks}:
        rows = [r for r in blocks if r.wide == size]
        by_size[size] = [r.block for r in rows], np.array([r.n for r in rows]), np.stack([np.array(r.centre) for r in rows]), np.array([r.radius for r in rows])
    table = spark.sparkContext.broadcast(by_size)

    def bounds(v: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(blocks, documents in each, upper bound of the cosine) for a query."""
        names, counts, centre, radius = table.value.get(len(v), ([], np.zeros(0, int), np.zeros((0, len(v))), np.zeros(0)))
        length = float(np.sqrt((v * v).sum()))
        if not length or not len(names):
            return names, counts, np.full(len(names), np.inf)
        gap = np.sqrt(((centre - v / length) ** 2).sum(1)) * (1 - 1e-9) - radius - 1e-9
        return names, counts, np.where(np.isinf(radius), np.inf, 1 - np.maximum(0, gap) ** 2 / 2 + 1e-9)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for q, v in zip(f["query_id"], f["v"], strict=True):
                names, counts, high = bounds(np.asarray(v))
                order = np.argsort(-high, kind="stable")
                enough = int(np.searchsorted(np.cumsum(counts[order]), k + 1)) + 1
                out.extend((q, v, names[i]) for i in order[:enough])
            yield pd.DataFrame(out, columns=["query_id", "v", "block"])

    def rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for q, v, bar in zip(f["query_id"], f["v"], f["bar"], strict=True):
                names, counts, high = bounds(np.asarray(v))
                order = np.argsort(-high, kind="stable")
                enough = int(np.searchsorted(np.cumsum(counts[order]), k + 1)) + 1
                out.extend((q, v, names[i]) for i in order[enough:] if np.isnan(bar) or high[i] >= bar)
            yield pd.DataFrame(out, columns=["query_id", "v", "block"])

    kind = dict(queries.dtypes)["query_id"]
    schema = f"query_id {kind}, v array<double>, block string"

    def meet(pairs: DataFrame) -> DataFrame:
        """Each block with its queries, ``asked`` at a time: a block that very many ask is copied to as many groups."""
        turns = pairs.groupBy("block").agg(F.ceil(F.count("*") / asked).alias("turns"))
        right = pairs.join(turns, "block").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns"))).drop("turns")
        left = laid.join(turns, "block").select("doc_id", "v", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"))
        return stored(_met(left, right, ["block", "turn"], k), "found")

    one = stored(some.mapInPandas(first, schema), "pairs")
    found = meet(one)
    bar = _ranked(found, k).where("score IS NOT NULL").groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("_low"))
    barred = some.join(bar, "query_id", "left").withColumn("bar", F.when(F.col("_n") == k, F.col("_low") - 1e-9))
    two = stored(barred.select("query_id", "v", "bar").mapInPandas(rest, schema), "pairs")
    found = found.unionByName(meet(two))
    per = {size: len(x[0]) for size, x in by_size.items()}
    pairs = sum(r["count"] * per.get(r.wide, 0) for r in some.groupBy(F.size("v").alias("wide")).count().collect())  # a row a length of vectors
    return _ranked(found, k), {"pairs": pairs, "met": one.count() + two.count()}


def in_order(rows: DataFrame, key: str, name: str, buckets: int = 256) -> DataFrame:
    """Adds ``name``: the row's number from 0 in the order of the distinct values of ``key``, without bringing all rows to one task."""
    return running(rows, [key], place=name, buckets=buckets)


def ring_draws(rows: DataFrame, key: str, group: Sequence[str], value: str, k: int) -> DataFrame:
    """Adds others: up to ``k`` values of the row's group besides its own, drawn by hash.

    The group's distinct values sit in a ring in the order of their MD5; a row starts at the place of its own hash and takes what follows. A row
    looks up k + 1 places, so neither a group's values nor pairs of row and value are ever gathered.
    """
    group = list(group)
    pool = rows.select(*group, value).distinct().withColumn("_h", F.concat(F.md5(value), F.lit("|"), value))
    if group:
        rows = rows.join(pool.groupBy(*group).agg(F.count("*").alias("_n")), group)
    else:
        rows = rows.crossJoin(F.broadcast(pool.agg(F.count("*").alias("_n"))))  # one row
    pool = running(pool, ["_h"], place="_seat", by=group)
    start = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    wanted = rows.select(*group, key, F.col(value).alias("_own"), "_n", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_n") - 1).cast("int"))).alias("_i"))
    wanted = wanted.withColumn("_seat", ((start + F.col("_i")) % F.col("_n")).cast("int"))
    found = wanted.join(pool.drop("_h").withColumn("_seat", F.col("_seat").cast("int")), [*group, "_seat"]).where(F.col(value) != F.col("_own"))
    held = found.groupBy(*group, key).agg(F.slice(F.array_sort(F.collect_list(F.struct("_i", value))), 1, k).alias("_x"))
    return rows.drop("_n").join(held, [*group, key], "left").withColumn("others", F.coalesce(F.transform("_x", lambda x: x[value]), F.array().cast("array<string>"))).drop("_x")


def ring_pick(rows: DataFrame, pool: DataFrame, key: str, group: Sequence[str], value: str, looks: Column, fits: Column) -> DataFrame:
    """Adds ``value``: of the distinct values of the row's group in ``pool`` the first that fits, null if none does.

    The values sit in a ring in the order of their MD5; a row starts at the place of its key's hash and looks at ``looks`` + 1 of them at most, which must be
    enough to pass those that don't fit. So a group's values are never gathered, and don't meet all its rows.
    """
    group = list(group)
    seats = running(pool.select(*group, value).where(F.col(value).isNotNull()).distinct().withColumn("_h", F.concat(F.md5(value), F.lit("|"), value)), ["_h"], place="_seat", by=group).drop("_h")
    start = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    wanted = rows.join(seats.groupBy(*group).agg(F.count("*").alias("_n")), group).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(looks.cast("long"), F.col("_n") - 1))))
    found = wanted.withColumn("_seat", (start + F.col("_i")) % F.col("_n")).join(seats, [*group, "_seat"]).where(fits)
    return rows.join(found.groupBy(*group, key).agg(F.min_by(value, "_i").alias(value)), [*group, key], "left")


def hash_sample(rows: DataFrame, key: str, k: int, seed: str = "0", group: Sequence[str] = ()) -> DataFrame:
    """``k`` rows in a repeatable random order, by the MD5 of key and seed."""
    drawn = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    if not group:
        return rows.orderBy(drawn, key).limit(k)
    order = Window.partitionBy(*group).orderBy(drawn, key)
    return rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")


def weighted_pick(rows: DataFrame, group: Sequence[str], value: str, seed: str = "0") -> DataFrame:
    """One value for each group, drawn in proportion to how often it occurs; the draw is the MD5 of group and seed."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*group)
    up = F.sum("n").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(by)
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", *group, F.lit(seed))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return counts.withColumn("up", up).withColumn("u", draw).where("up > u").groupBy(*group).agg(F.min_by(value, "up").alias(value))


def look_back_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, weight: str, keep: int = 20) -> DataFrame:
    """Adds middle (the lower one), mean, highest and latest of the last ``keep`` values of a key, and the mean and the weighted mean so far."""
    by = Window.partitionBy(*keys).orderBy(*order)
    last, all_ = by.rowsBetween(1 - keep, 0), by.rowsBetween(Window.unboundedPreceding, 0)
    held = F.array_sort(F.collect_list(value).over(last))
    return rows.withColumns({
        "middle": F.get(held, ((F.size(held) - 1) / 2).cast("int")), "mean": F.avg(value).over(last), "highest": F.max(value).over(last), "latest": F.col(value),
        "so_far": F.avg(value).over(all_), "weighted": F.try_divide(F.sum(F.col(value) * F.col(weight)).over(all_), F.sum(weight).over(all_)),
    })


def neighbours(queries: DataFrame, docs: DataFrame, k: int, skip_own: bool = False, held: int = 65536) -> DataFrame:
    """(query_id, rank, doc_key, score) of each query (query_id, index, v) in its own index of docs (index, pos, doc_key, v).

    The best ``k`` by cosine, ties by ``pos``; with 1, where the best is the summary, the second too, so that a clip always comes; with -1 all, in the order of
    ``pos``, without a score. An index is one video's memory: it meets its queries in parts of about ``held`` documents, as products of matrices, of which
    only the best leave. With ``skip_own`` a query doesn't find the document whose pos is its id.
    """
    if k == -1:
        pairs = queries.select("query_id", "index").join(docs.select("index", "pos", "doc_key"), "index")
        pairs = pairs.where(F.col("query_id") != F.col("pos")) if skip_own else pairs
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
        return pairs.select("query_id", rank.alias("rank"), "doc_key", F.lit(None).cast("double").alias("score"))
    wide = lambda df, *c: df.select(*c, "index", F.transform("v", lambda x: x.cast("double")).alias("v"))
    parts = docs.groupBy("index").agg(F.ceil(F.count("*") / held).alias("parts"))
    left = wide(docs, F.col("pos").alias("doc_id")).join(parts, "index").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).drop("parts")
    right = wide(queries, "query_id").join(parts, "index").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    rows = _ranked(_met(left, right, ["index", "part"], max(k, 2), skip_own), max(k, 2))
    rows = rows.join(queries.select("query_id", "index"), "query_id").join(docs.select("index", F.col("pos").alias("doc_id"), "doc_key"), ["index", "doc_id"])
    if k == 1:
        best = F.max(F.when(F.col("rank") == 1, F.col("doc_key"))).over(Window.partitionBy("query_id"))
        rows = rows.withColumn("_k", (F.col("rank") <= k) | (best == "summary")).where("_k")
    else:
        rows = rows.where(F.col("rank") <= k)
    return rows.select("query_id", "rank", "doc_key", "score")


def run_counters(work: DataFrame, done: DataFrame, failed: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(*by, total, skipped, processed, failed): skipped was done before; of the rest, failed are those listed."""
    mark = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    rows = work.join(mark(done, "_d"), list(keys), "left").join(mark(failed, "_f"), list(keys), "left")
    old, bad = F.coalesce("_d", F.lit(False)), F.coalesce("_f", F.lit(False))
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(old).alias("skipped"), F.count_if(~old & ~bad).alias("processed"), F.count_if(~old & bad).alias("failed"))


def shuffled(rows: DataFrame, key: str, epochs: int = 1, within: Sequence[str] = ()) -> DataFrame:
    """Each row once an epoch with its ``place``, from 1, in that epoch's order, by the MD5 of key and epoch, in each group of ``within``."""
    out = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    out = out.withColumn("_drawn", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("epoch").cast("string"))))
    return running(out, ["_drawn", key], place="place", by=["epoch", *within]).withColumn("place", (F.col("place") + 1).cast("int")).drop("_drawn")


def drawn_mixture(rows: DataFrame, source: str, key: str, ratios: DataFrame, draws: int, seed: str, cells: int = 1024) -> DataFrame:
    """(draw, key, source): each draw takes a source by its ratio (source, ratio), then that source's next row; a source that runs out starts again.

    Ratios become ranges of 0 to 1 by running sums, which draws meet in ``cells`` cells of equal width; draws and rows of a source are numbered in
    buckets. So there may be any number of sources, and one may have nearly all rows.
    """
    ranges = running(ratios.where("ratio > 0").select(source, F.col("ratio").cast("double").alias("ratio")), [source], {"up": F.col("ratio")})
    ranges = ranges.crossJoin(F.broadcast(ratios.where("ratio > 0").agg(F.sum(F.col("ratio").cast("double")).alias("_all"))))  # one row
    ranges = ranges.select(F.col(source), ((F.col("up") - F.col("ratio")) / F.col("_all")).alias("_low"), (F.col("up") / F.col("_all")).alias("_up"))
    ranges = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_low") * cells), F.least(F.floor(F.col("_up") * cells), F.lit(cells - 1).cast("long")))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("double") / 4294967296.0
    drawn = rows.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("_u", u).withColumn("_cell", F.floor(F.col("_u") * cells))
    drawn = drawn.join(ranges, "_cell").where("_u >= _low AND _u < _up").select("draw", source)
    drawn = running(drawn, ["draw"], place="_turn", by=[source]).join(rows.groupBy(source).agg(F.count("*").alias("_n")), source)
    seats = running(rows.withColumn("_drawn", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))), ["_drawn", key], place="_seat", by=[source])
    return drawn.withColumn("_seat", F.col("_turn") % F.col("_n")).join(seats, [source, "_seat"]).select("draw", key, source)


def pick_by_weight(rows: DataFrame, group: Sequence[str], value: str, weight: str, seed: str = "0") -> DataFrame:
    """One value for each group in proportion to its weight, by the MD5 of group and seed; weights that are all 0 count alike."""
    by = Window.partitionBy(*group)
    own = F.when(F.sum(weight).over(by) > 0, F.col(weight)).otherwise(1)
    rows = rows.withColumn("_w", own)
    up = F.sum("_w").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_w").over(by)
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(g).cast("string") for g in group), F.lit(seed))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return rows.withColumn("up", up).withColumn("u", draw).where("up > u").groupBy(*group).agg(F.min_by(value, "up").alias(value))


def grouped_join(rows: DataFrame, others: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the list of their values, rows without any); the second must be empty where every row has to have one."""
    lists = others.groupBy(key).agg(F.collect_list(value).alias(value))
    return rows.join(lists, key), rows.join(lists, key, "left_anti")


def on_leaves(tree: Column, f) -> Column:
    """A map of arrays with ``f`` on every element."""
    return F.transform_values(tree, lambda _, v: F.transform(v, lambda x: f(x)))
