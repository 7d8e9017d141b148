"""Folders that the driver and all executors share, and files of any store by their address."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset and all of Spark runs in this process is a temporary one made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back, so that they are made once and survive lost executors.

    The files stay there, as plans that read them may be run again; whoever owns the folder clears it.
    """
    place = scratch(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or address: local, file:, hdfs:, s3: and what else Arrow knows."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Joined(io.RawIOBase):
    """Files one after another, read as one that can be searched; each is opened when it is first read."""

    def __init__(self, paths: Sequence[str]):
        self.parts = [store_of(p) for p in paths]
        self.sizes = [store.get_file_info(p).size for store, p in self.parts]
        if None in self.sizes:
            raise FileNotFoundError(paths[self.sizes.index(None)])
        self.size, self.at, self.open_, self.files = sum(self.sizes), 0, -1, None

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def readinto(self, buffer) -> int:
        first = 0
        for i, size in enumerate(self.sizes):
            if self.at < first + size:
                if self.open_ != i:
                    if self.files:
                        self.files.close()
                    self.open_, self.files = i, self.parts[i][0].open_input_file(self.parts[i][1])
                self.files.seek(self.at - first)
                data = self.files.read(min(len(buffer), first + size - self.at))
                buffer[: len(data)] = data
                self.at += len(data)
                return len(data)
            first += size
        return 0

    def close(self) -> None:
        if self.files:
            self.files.close()
        super().close()
