"""Deterministic ids as Column builders (md5 and name-based uuids), without Python functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def dashed(hex32: Column) -> Column:
    """32 hex digits in the 8-4-4-4-12 form."""
    cut = lambda a, n: F.substring(hex32, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def _quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c.cast("string"), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))


def _json_value(c: Column, kind: str) -> Column:
    return F.coalesce(_quote(c) if kind == "string" else c.cast("string"), F.lit("null"))


def jsonb_uuid(fields: dict[str, tuple[Column, str]]) -> Column:
    """md5 uuid of a JSON object whose keys are ordered by (length, bytes); fields: name -> (column, 'string' | 'number').

    Nulls are written as null. The key order is static, so it is decided when the plan is built.
    """
    keys = sorted(fields, key=lambda k: (len(k.encode()), k.encode()))
    parts = [F.concat(F.lit(f'"{k}": '), _json_value(*fields[k])) for k in keys]
    return dashed(F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))))


def sorted_json_uuid(fields: dict[str, tuple[Column, str]]) -> Column:
    """md5 uuid of a JSON object with alphabetical keys: the other of the two incompatible schemes."""
    parts = [F.concat(F.lit(f'"{k}": '), _json_value(*fields[k])) for k in sorted(fields)]
    return dashed(F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))))


def _named(hexed: Column, version: str) -> Column:
    third = F.concat(F.lit(version), F.substring(hexed, 14, 3))
    variant = F.lower(F.hex(F.conv(F.substring(hexed, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), third, F.concat(variant, F.substring(hexed, 18, 3)), F.substring(hexed, 21, 12))


def uuid5(name: Column, namespace: str = NAMESPACE_DNS) -> Column:
    """Name-based uuid, version 5 (sha1)."""
    return _named(F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8"))), "5")


def uuid3(name: Column, namespace: str = NAMESPACE_DNS) -> Column:
    """Name-based uuid, version 3 (md5)."""
    return _named(F.md5(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8"))), "3")
