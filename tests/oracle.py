"""Spark rows against DuckDB rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(x):
    return None if x is None else round(x, 6) + 0.0 if isinstance(x, float) else str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, connection, sql):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = connection.sql(sql)
    want = rows_of(found.columns, found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    bad = [(g, w) for g, w in zip(got[1], want[1], strict=True) if g != w]
    assert not bad, (len(bad), str(bad[:2])[:1500])
    kinds = [(c, a, b) for c, a, b in zip(sorted(df.columns), [dict(df.dtypes)[c] for c in sorted(df.columns)], [str(dict(zip(found.columns, found.types, strict=True))[c]) for c in sorted(df.columns)], strict=True)]
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    off = [k for k in kinds if same.get(k[1]) != k[2]]
    assert not off, off
