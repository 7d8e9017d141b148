"""A result store with commits: readers see whole commits only, a batch counts once, and a key has one row, whoever writes at the same time."""

from __future__ import annotations

import contextlib
import json
import os
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """Rows that one commit added: a folder of parquet files, with the batch they are of."""

    folder: str
    batch: str | None


class ResultStore:
    """Parquet files in ``folder``/data and a manifest for each version in ``folder``/commits, which lists the parts that belong to it.

    Rows are staged first, in a folder of their own, where no reader looks. The commit is the creation of the next version's manifest, which only
    one writer can do; another tries again on top of it. So a writer that is killed leaves nothing but a folder that nobody
    refers to (see tidy), and a reader keeps the version that it opened. Manifests are read by the driver and hold a line a part; compact
    makes them one part.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # --- manifests -------------------------------------------------------------------------------

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, store = self._path("commits")
        if not store.exists(path):
            return []
        names = [s.getPath().getName() for s in store.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{12}\.json", n))

    def parts(self, version: int | None = None) -> list[Part]:
        """The parts of a version, the latest by default."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if not version:
            return []
        path, store = self._path(f"commits/{version:012d}.json")
        stream = store.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Part(p["folder"], p["batch"]) for p in json.loads(text)["parts"]]

    def _create(self, version: int, parts: Sequence[Part]) -> bool:
        """Makes the manifest of a version; False if it is there already."""
        held = f"commits/.{uuid.uuid4().hex}"
        path, store = self._path(held)
        store.mkdirs(path.getParent())
        out = store.create(path, False)
        out.write(json.dumps({"parts": [{"folder": p.folder, "batch": p.batch} for p in parts]}).encode())
        out.close()
        target, _ = self._path(f"commits/{version:012d}.json")
        try:
            if store.getScheme() == "file":
                os.link(path.toUri().getPath(), target.toUri().getPath())  # a local rename would replace
            else:
                jvm = self.spark._jvm
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
                kind = jvm.org.apache.hadoop.fs.Options.Rename
                none = self.spark.sparkContext._gateway.new_array(kind, 0)
                context.rename(path, target, none)
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            with contextlib.suppress(Exception):
                store.delete(path, False)
        return True

    # --- rows ------------------------------------------------------------------------------------

    def _stage(self, rows: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def _rows(self, parts: Sequence[Part]) -> DataFrame | None:
        parts = [p for p in parts if p.folder]
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.folder}/{p.folder}" for p in parts)) if parts else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the latest by default; None before the first commit."""
        return self._rows(self.parts(version))

    def append(self, rows: DataFrame, batch: str | None = None, keys: Sequence[str] = (), order: Sequence[str | Column] = (), tries: int = 100) -> int | None:
        """Commits rows and returns the new version; None if ``batch`` was committed before.

        With ``keys`` the first row of a key by ``order`` is kept, and only if the store has none: what another writer commits
        in the meantime is met by another anti-join, with the new parts only, before the next try.
        """
        if batch is not None and any(p.batch == batch for p in self.parts()):
            return None
        if keys:
            first = Window.partitionBy(*keys).orderBy(*order)
            rows = rows.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
        staged, seen = None, set()
        for _ in range(tries):
            known = self.versions()
            base = known[-1] if known else 0
            parts = self.parts(base)
            if batch is not None and any(p.batch == batch for p in parts):
                return None
            fresh = [p for p in parts if p.folder not in seen]
            if staged is None or (keys and fresh):
                left = rows if staged is None else self._rows([Part(staged, None)])
                have = self._rows(fresh) if keys else None
                staged = self._stage(left if have is None else left.join(have.select(*keys).distinct(), list(keys), "left_anti").select(*left.columns))
                seen = {p.folder for p in parts}
            if self._create(base + 1, [*parts, Part(staged, batch)]):
                return base + 1
        raise TimeoutError(f"{tries} other commits came first")

    def compact(self, tries: int = 100) -> int:
        """Makes one part of those of the latest version. Batches stay known by a part without rows each."""
        for _ in range(tries):
            known = self.versions()
            base = known[-1] if known else 0
            parts = self.parts(base)
            if len([p for p in parts if p.folder]) < 2:
                return base
            names = [Part("", p.batch) for p in parts if p.batch is not None]
            if self._create(base + 1, [Part(self._stage(self._rows([p for p in parts if p.folder])), None), *names]):
                return base + 1
        raise TimeoutError(f"{tries} other commits came first")

    def tidy(self) -> list[str]:
        """Deletes folders that no version refers to, and returns them. Not while others write: what they have staged is such a folder."""
        used = {p.folder for v in self.versions() for p in self.parts(v)}
        path, store = self._path("data")
        gone = [f"data/{s.getPath().getName()}" for s in store.listStatus(path)] if store.exists(path) else []
        gone = sorted(g for g in gone if g not in used)
        for name in gone:
            store.delete(self._path(name)[0], True)
        return gone
