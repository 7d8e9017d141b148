"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotloom.functions.text import BLANK

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function from a table reader to a DataFrame under its name, with the SQL that must give the same rows, if SQL can."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql.replace(r" \t\n\x0B\f\r", BLANK)  # white space, as the operators take it
        return f

    return add
