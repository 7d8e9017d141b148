"""Fetching of listed files by a caller's function: in parallel, once, with failures as rows."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scripts(listing: DataFrame) -> DataFrame:
    """The listed names that end in .html."""
    return listing.where(F.col("name").endswith(".html"))


def fetched(listing: DataFrame, folder: str, get: Callable[[str], bytes], parts: int = 10) -> DataFrame:
    """(name, state, bytes, error) of rows (name, url[, md5]): 'kept' what is in the shared folder already, 'fetched', or 'failed'.

    Each of ``parts`` tasks fetches its share. A file is whole or not there; one whose MD5 differs from a given one fails.
    """
    folder = folder.removeprefix("file://").rstrip("/")
    rows = listing if "md5" in listing.columns else listing.withColumn("md5", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for f in frames:
            out = []
            for r in f.itertuples():
                path = f"{folder}/{r.name}"
                if os.path.exists(path):
                    out.append((r.name, "kept", os.path.getsize(path), None))
                    continue
                try:
                    body = get(r.url)
                    if r.md5 and hashlib.md5(body).hexdigest() != r.md5:
                        raise ValueError("another MD5 than listed")
                    part = f"{path}.{os.getpid()}.part"
                    with open(part, "wb") as file:
                        file.write(body)
                    os.replace(part, path)
                    out.append((r.name, "fetched", len(body), None))
                except Exception as e:  # a fetch may fail in any way
                    out.append((r.name, "failed", 0, str(e)))
            yield pd.DataFrame(out, columns=["name", "state", "bytes", "error"])

    return rows.select("name", "url", "md5").repartition(parts).mapInPandas(run, "name string, state string, bytes long, error string")


def counted(states: DataFrame) -> DataFrame:
    """(state, n)."""
    return states.groupBy("state").agg(F.count("*").alias("n"))
