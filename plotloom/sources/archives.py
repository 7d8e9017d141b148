"""Tar archives of any size: an index of their members, reading members by byte range in many tasks, samples of shards, and writing shards."""

from __future__ import annotations

import contextlib
import io
import json
import tarfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plotloom.sources.scratch import Joined, store_of, stored

_INDEX = "archive string, place long, member string, offset long, size long"


class _Archive(InputPartition):
    def __init__(self, name: str):
        self.name = name


class TarIndex(DataSource):
    """``spark.read.format("tar_index").load(folder or file)``: a row for each regular file in each tar archive, made from the headers alone.

    offset and size say where its bytes lie. An archive is one partition; its members' bytes are skipped. Option ``parts``, a JSON list of
    paths in order, reads those as one archive, which then has the paths, a line each, for its name. An archive that can't be
    read to its end gives the members that came before and lie in it whole; a file that is no archive gives none.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_index"

    def schema(self) -> str:
        return _INDEX

    def reader(self, schema) -> DataSourceReader:
        return _TarReader(dict(self.options))


class _TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        if "parts" in self.options:
            return [_Archive("\n".join(json.loads(self.options["parts"])))]
        store, path = store_of(self.options["path"])
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        own = [info] if info.is_file else store.get_file_info(fs.FileSelector(path))
        scheme = self.options["path"].split("://")[0] + "://" if "://" in self.options["path"] and not self.options["path"].startswith("file:") else ""
        return [_Archive(scheme + i.path) for i in sorted(own, key=lambda i: i.path) if i.is_file and i.path.endswith(".tar")]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for place, (member, offset, size) in enumerate(walk(partition.name)):
            rows.append((partition.name, place, member, offset, size))
            if len(rows) == 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "place", "member", "offset", "size"])


def walk(archive: str) -> Iterator[tuple[str, int, int]]:
    """(name, offset, size) of the regular files of an archive, up to where it can't be read."""
    with Joined(archive.split("\n")) as whole, contextlib.suppress(tarfile.TarError, EOFError, OSError), tarfile.open(fileobj=io.BufferedReader(whole, 1 << 16), mode="r:") as tar:
        while (member := tar.next()) is not None:
            if member.isreg() and member.sparse is None and member.offset_data + member.size <= whole.size:
                yield member.name, member.offset_data, member.size
            tar.members = []  # else it keeps all


def tar_index(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(archive, place, member, offset, size) of the archives in a folder, or of one; a list is the parts of one archive, in order. See TarIndex."""
    spark.dataSource.register(TarIndex)
    reader = spark.read.format("tar_index")
    return reader.load(path) if isinstance(path, str) else reader.option("parts", json.dumps(list(path))).load()


def _ranges(index: DataFrame, range_bytes: int) -> DataFrame:
    """The rows dealt to tasks by archive and byte range, in order; a number of tasks that follows the bytes, which the rows' own size says nothing about."""
    total = index.agg(F.sum("size")).first()[0] or 0
    return index.repartition(max(1, -(-total // range_bytes)), "archive", F.floor(F.col("offset") / range_bytes)).sortWithinPartitions("archive", "offset")


def members(index: DataFrame, range_bytes: int = 64 << 20) -> DataFrame:
    """Adds content, the members' bytes, to rows of tar_index with any further columns.

    A task reads members of some ranges of ``range_bytes`` bytes, so an archive of any size is read by many tasks. The index is read
    twice: store it, or what is wanted of it, before.
    """
    names = index.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, whole = None, None
        for b in batches:
            archive, offset, size = (b.column(names.index(c)).to_pylist() for c in ("archive", "offset", "size"))
            at, bodies, held = 0, [], 0
            for i, (a, o, n) in enumerate(zip(archive, offset, size, strict=True)):
                if a != name:
                    name, whole = a, io.BufferedReader(Joined(a.split("\n")), 1 << 16)
                whole.seek(o)
                bodies.append(whole.read(n))
                held += n
                if held > 4 << 20 or i + 1 == b.num_rows:
                    part = b.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bodies, pa.binary())], [*names, "content"])
                    at, bodies, held = i + 1, [], 0

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return _ranges(index, range_bytes).mapInArrow(read, f"{fields}, content binary")


def samples(index: DataFrame, needed: Sequence[str] = ("json", "jpg")) -> DataFrame:
    """(archive, sample, endings) of members named ``<sample>.<ending>`` in any folder: those samples that have all ``needed`` endings.

    endings maps an ending to its member's (offset, size); of two members with one name the later counts. Made from the index alone.
    """
    file = F.element_at(F.split("member", "/"), -1)
    parts = index.select("archive", "place", F.substring_index(file, ".", 1).alias("sample"), F.substr(file, F.length(F.substring_index(file, ".", 1)) + 2).alias("ending"), "offset", "size")
    last = parts.groupBy("archive", "sample", "ending").agg(F.max_by(F.struct("offset", "size"), "place").alias("at"))
    found = last.groupBy("archive", "sample").agg(F.map_from_entries(F.collect_list(F.struct("ending", "at"))).alias("endings"))
    return found.where(" AND ".join(f"map_contains_key(endings, '{e}')" for e in needed))


def shards(spark: SparkSession, path: str, schema: str, range_bytes: int = 64 << 20) -> DataFrame:
    """(shard, sample, *schema) of tar archives whose members ``<sample>.json`` and ``<sample>.jpg`` make samples.

    A sample needs both. An archive that can't be read to its end gives what came before; a member whose JSON is bad gives none. Archives may be of
    any size: samples are found in the index (stored in the shared folder), and only their JSON is read, by byte ranges in many tasks.
    """
    index = stored(samples(tar_index(spark, path)).select("archive", "sample", F.col("endings")["json"]["offset"].alias("offset"), F.col("endings")["json"]["size"].alias("size")), "tar-index")
    text = members(index, range_bytes).select(F.element_at(F.split("archive", "/"), -1).alias("shard"), "sample", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("body"))
    rows = text.where(F.try_parse_json("body").isNotNull() & F.ltrim("body").startswith("{"))
    return rows.select("shard", "sample", F.from_json("body", f"struct<{schema}>").alias("a")).where("a IS NOT NULL").select("shard", "sample", "a.*")


def archive_members(spark: SparkSession, parts: Sequence[str], keep: str = "friends/") -> DataFrame:
    """(member, season, bytes, archive, offset, size) of the tar archive that is cut into ``parts``, in their order: members whose path holds /friends/ in any case,
    or starts with the prefix.

    season is the first part of the path that holds 'season'. All parts are required. Only headers are read, from the parts as they lie.
    """
    rows = tar_index(spark, parts).where(F.contains(F.lower("member"), F.lit(f"/{keep}")) | F.startswith(F.col("member"), F.lit(keep)))
    season = F.get(F.filter(F.split("member", "/"), lambda p: F.contains(F.lower(p), F.lit("season"))), 0)
    return rows.select("member", season.alias("season"), F.col("size").alias("bytes"), "archive", "offset", "size")


def extract(index: DataFrame, folder: str, range_bytes: int = 64 << 20) -> DataFrame:
    """Writes the members of an index below ``folder`` under their own names; (member, bytes) when it runs.

    A member is copied in pieces, so its size doesn't matter, and moved to its name when it is whole: a task that is run again replaces what it
    wrote. Names that lead out of the folder are an error.
    """

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        for b in batches:
            rows = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("archive", "member", "offset", "size")]
            for archive, member, offset, size in zip(*rows, strict=True):
                if member.startswith("/") or ".." in member.split("/"):
                    raise ValueError(f"{member} leads out of the folder")
                target, left = f"{root}/{member}", size
                store.create_dir(target.rpartition("/")[0], recursive=True)
                held = f"{target}.{uuid.uuid4().hex}"
                with io.BufferedReader(Joined(archive.split("\n")), 1 << 16) as whole, store.open_output_stream(held) as out:
                    whole.seek(offset)
                    while left:
                        piece = whole.read(min(left, 1 << 20))
                        out.write(piece)
                        left -= len(piece)
                store.move(held, target)
            yield pa.RecordBatch.from_pydict({"member": rows[1], "bytes": pa.array(rows[3], pa.int64())})

    return _ranges(index.select("archive", "member", "offset", "size"), range_bytes).mapInArrow(copy, "member string, bytes long")


def write_shards(rows: DataFrame, folder: str, samples_each: int = 10_000) -> DataFrame:
    """Writes (sample, ending, content) rows, a sample's next to each other in a partition, as tar archives; (shard, members, bytes) of each, when run.

    An archive has at most ``samples_each`` samples and is moved to its name, by partition and number, when it is whole.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        number, tar, out, held, n, size, last, seen = 0, None, None, "", 0, 0, None, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            tar.close()
            out.close()
            name = f"{TaskContext.get().partitionId():05d}-{number:05d}.tar"
            store.move(held, f"{root}/{name}")
            done.append((name, n, size))

        for b in batches:
            for sample, ending, content in zip(*(b.column(b.schema.get_field_index(c)) for c in ("sample", "ending", "content")), strict=True):
                sample, body = sample.as_py(), content.as_py() or b""
                if sample != last:
                    if tar is not None and seen == samples_each:
                        close()
                        tar, number = None, number + 1
                    if tar is None:
                        held = f"{root}/{uuid.uuid4().hex}.part"
                        out = store.open_output_stream(held)
                        tar, n, size, seen = tarfile.open(fileobj=out, mode="w|"), 0, 0, 0
                    last, seen = sample, seen + 1
                info = tarfile.TarInfo(f"{sample}.{ending.as_py()}")
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
                n, size = n + 1, size + len(body)
        if tar is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["shard", "members", "bytes"])

    return rows.select("sample", "ending", F.col("content").cast("binary").alias("content")).mapInArrow(write, "shard string, members long, bytes long")
