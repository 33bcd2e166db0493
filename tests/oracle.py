"""Runs a query and its SQL side by side, on the same Parquet tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in sorted(glob.glob(os.path.join(folder, "*.parquet"))):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def _cell(v: object) -> object:
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _rows(rows: list[tuple]) -> list[tuple]:
    return sorted((tuple(_cell(v) for v in r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


KIND = {"int": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "string": "str", "boolean": "bool", "timestamp_ntz": "time", "timestamp": "time", "date": "date"}
DUCK = {"BIGINT": "int", "INTEGER": "int", "SMALLINT": "int", "TINYINT": "int", "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "str", "BOOLEAN": "bool", "TIMESTAMP": "time", "DATE": "date", "HUGEINT": "huge", "UUID": "uuid"}


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences between a Spark frame and an SQL result; empty if there are none."""
    out = []
    names = sorted(df.columns)
    rel = con.sql(sql)
    other = sorted(rel.columns)
    if names != other:
        return [f"columns {names} against {other}"]
    kinds = {n: KIND.get(t, t) for n, t in df.dtypes}
    duck = {n: DUCK.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types, strict=True)}
    out += [f"type of {n}: {kinds[n]} against {duck[n]}" for n in names if kinds[n] != duck[n]]
    a = _rows([tuple(r) for r in df.select(*names).collect()])
    b = _rows(con.sql(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({sql})").fetchall())
    if len(a) != len(b):
        out.append(f"{len(a)} rows against {len(b)}")
    diff = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    if diff:
        out.append(f"{len(diff)} rows differ, first {diff[0]}")
    return out
