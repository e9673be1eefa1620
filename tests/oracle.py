"""Compare a query's Spark rows with DuckDB's, whatever their order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """A value as text; -0.0 stays apart from 0.0, as a strict comparison would keep it."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
         "boolean": "BOOLEAN", "smallint": "SMALLINT"}


def compare(df, sql: str, sf_dir: str) -> list[str]:
    """The differences, none when the two agree."""
    found = duck(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]) for d in found.description}
    expected = rows_of(names, found.fetchall())
    actual = rows_of(df.columns, df.collect())
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} against {sorted(names)}")
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != kinds.get(name):
            problems.append(f"type of {name}: {kind} against {kinds.get(name)}")
    if len(actual) != len(expected):
        problems.append(f"{len(actual)} rows against {len(expected)}")
    different = [(a, b) for a, b in zip(actual, expected) if a != b]
    if different:
        problems.append(f"{len(different)} rows differ, first {different[0]}")
    return problems
