"""Type maps between Python hints, SQL names, Arrow, JSON Schema and Spark, and a registry of entities that only ever grows."""

from __future__ import annotations

import datetime as dt
import types
import typing
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYSTEM = [T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()), T.StructField("deleted_at", T.TimestampType()), T.StructField("userid", T.StringType()), T.StructField("groupid", T.StringType()), T.StructField("required_access_level", T.IntegerType())]


def _args(hint: object) -> tuple[list[object], bool]:
    """Members of a union without None, and whether None was one."""
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        a = [x for x in typing.get_args(hint) if x is not type(None)]
        return a, len(a) < len(typing.get_args(hint))
    return [hint], False


def sql_type(hint: object, varchar_length: int | None = None, override: str | None = None) -> str:
    """SQL type name of a Python hint; in unions UUID wins, then JSON, TEXT[] and TIMESTAMP; other unions are an error."""
    if override:
        return override
    members, _ = _args(hint)
    if len(members) > 1:
        names = [sql_type(m) for m in members]
        for best in ("UUID", "JSON", "TEXT[]", "TIMESTAMP"):
            if best in names:
                return best
        if len(set(names)) == 1:
            return names[0]
        raise ValueError(f"no single type for {hint}")
    h = members[0]
    origin, args = typing.get_origin(h), typing.get_args(h)
    if origin in (list, set, tuple) or h in (list, set, tuple):
        inner = sql_type(args[0]) if args else "TEXT"
        return "JSON" if inner == "JSON" else f"{inner}[]"
    if origin is dict or h is dict:
        return "JSON"
    if h is str or h is typing.Any:
        return f"VARCHAR({varchar_length})" if varchar_length else "TEXT"
    simple = {bool: "BOOLEAN", int: "INTEGER", float: "REAL", uuid.UUID: "UUID", dt.datetime: "TIMESTAMP"}
    if h in simple:
        return simple[h]
    if isinstance(h, type) and hasattr(h, "__annotations__"):
        return "JSON"
    raise ValueError(f"no SQL type for {hint}")


def spark_type(name: str) -> T.DataType:
    """Spark type of an SQL type name; whole numbers are long and REAL is double, so that both other maps fit."""
    n = name.strip().upper()
    if n.endswith("[]"):
        return T.ArrayType(spark_type(n[:-2]))
    if n.startswith("VECTOR"):
        return T.ArrayType(T.FloatType())
    if n.startswith("VARCHAR"):
        return T.StringType()
    known = {"TEXT": T.StringType(), "UUID": T.StringType(), "JSON": T.StringType(), "INTEGER": T.LongType(), "BIGINT": T.LongType(), "REAL": T.DoubleType(), "NUMERIC": T.DoubleType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(), "DATE": T.DateType(), "BYTEA": T.BinaryType()}
    if n in known:
        return known[n]
    raise ValueError(f"no Spark type for {name}")


def from_arrow(t: pa.DataType) -> T.DataType:
    """Arrow to table types, widened: whole numbers to long, floats to double, dates to timestamp, anything unknown to string."""
    if pa.types.is_integer(t):
        return T.LongType()
    if pa.types.is_floating(t) or pa.types.is_decimal(t):
        return T.DoubleType()
    if pa.types.is_boolean(t):
        return T.BooleanType()
    if pa.types.is_timestamp(t) or pa.types.is_date(t):
        return T.TimestampType()
    if pa.types.is_binary(t) or pa.types.is_large_binary(t):
        return T.BinaryType()
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return T.ArrayType(from_arrow(t.value_type))
    if pa.types.is_map(t):
        return T.MapType(from_arrow(t.key_type), from_arrow(t.item_type))
    if pa.types.is_struct(t):
        return T.StructType([T.StructField(f.name, from_arrow(f.type), f.nullable) for f in t])
    return T.StringType()


def from_json_schema(schema: dict) -> dict[str, object]:
    """Field name to Python hint of a JSON Schema object; fields that are not required are optional."""
    required = set(schema.get("required", []))

    def hint(s: dict) -> object:
        if "anyOf" in s or "oneOf" in s:
            kinds = [hint(x) for x in s.get("anyOf", s.get("oneOf", [])) if x.get("type") != "null"]
            null = any(x.get("type") == "null" for x in s.get("anyOf", s.get("oneOf", [])))
            out = kinds[0] if len(set(map(str, kinds))) == 1 else typing.Union[tuple(kinds)] if kinds else typing.Any
            return typing.Optional[out] if null else out
        t = s.get("type")
        if t == "string":
            return {"date": dt.date, "date-time": dt.datetime, "uuid": uuid.UUID}.get(s.get("format"), str)
        if t == "array":
            return list[hint(s.get("items", {}))]
        return {"integer": int, "number": float, "boolean": bool, "object": dict}.get(t, typing.Any)

    return {n: hint(s) if n in required else typing.Optional[hint(s)] for n, s in schema.get("properties", {}).items()}


@dataclass
class EntityType:
    name: str
    fields: dict[str, str]
    key: str | None = None
    embedded: dict[str, str] = field(default_factory=dict)
    description: str = ""

    def __post_init__(self) -> None:
        if self.key is None:
            self.key = next((k for k in ("name", "key") if k in self.fields), "id")

    def schema(self) -> T.StructType:
        own = [T.StructField(n, spark_type(t), n not in ("id",)) for n, t in self.fields.items()]
        have = {f.name for f in own}
        return T.StructType(own + [f for f in SYSTEM if f.name not in have])


class Registry:
    """Entities by name. Registering a known one again may add fields; it never drops or changes any."""

    def __init__(self) -> None:
        self.entities: dict[str, EntityType] = {}

    def register(self, entity: EntityType, plan: bool = False) -> list[str]:
        """Statements that the registration stands for; with ``plan`` nothing is registered."""
        old = self.entities.get(entity.name)
        if old is None:
            cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entity.schema())
            script = [f"CREATE TABLE {entity.name} ({cols})"]
            if entity.embedded:
                script.append(f"CREATE TABLE {entity.name}_embeddings (id string, source_record_id string, column_name string, embedding_vector array<float>, embedding_name string, created_at timestamp)")
            merged = entity
        else:
            new = {n: t for n, t in entity.fields.items() if n not in old.fields}
            script = [f"ALTER TABLE {entity.name} ADD COLUMN {n} {spark_type(t).simpleString()}" for n, t in new.items()]
            merged = EntityType(old.name, old.fields | new, old.key, old.embedded | entity.embedded, old.description)
        if not plan:
            self.entities[entity.name] = merged
        return script

    def conform(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` with the columns of the entity, in order: missing ones null, others dropped."""
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.entities[name].schema()])

    def model_fields(self) -> list[tuple[str, str, str, str | None, bool]]:
        return [(n, e.name, t, e.embedded.get(n), n == e.key) for e in self.entities.values() for n, t in e.fields.items()]


def openapi_functions(spec: dict, verbs: str | list[str] | None = None, operations: list[str] | None = None) -> list[dict]:
    """Function specifications of an OpenAPI document: name, verb, endpoint, description, parameters; references are resolved."""
    wanted = {v.strip().lower() for v in (verbs.split(",") if isinstance(verbs, str) else verbs)} if verbs else None

    def deref(x: object, depth: int = 0) -> object:
        if depth > 12:
            return x
        if isinstance(x, dict):
            if "$ref" in x:
                at: object = spec
                for part in x["$ref"].lstrip("#/").split("/"):
                    at = at.get(part, {}) if isinstance(at, dict) else {}
                return deref(at, depth + 1)
            return {k: deref(v, depth + 1) for k, v in x.items()}
        return [deref(v, depth + 1) for v in x] if isinstance(x, list) else x

    out = []
    for path, ops in spec.get("paths", {}).items():
        for verb, op in ops.items():
            if not isinstance(op, dict) or (wanted and verb.lower() not in wanted):
                continue
            name = op.get("operationId") or f"{verb}_{path.strip('/')}".replace("/", "_").replace("-", "_").replace("{", "").replace("}", "")
            if operations and name not in operations:
                continue
            props, needed = {}, []
            for p in deref(op.get("parameters", [])):
                props[p["name"]] = {**p.get("schema", {"type": "string"}), "description": p.get("description", "")}
                if p.get("required"):
                    needed.append(p["name"])
            body = deref(op.get("requestBody", {})).get("content", {}).get("application/json", {}).get("schema", {})
            props |= body.get("properties", {})
            needed += body.get("required", [])
            out.append({"name": name, "verb": verb.lower(), "endpoint": path, "description": op.get("description") or op.get("summary") or "", "parameters": {"type": "object", "properties": props, "required": needed}})
    return out


def callable_spec(f: typing.Callable) -> dict:
    """Function specification of a Python callable, from its signature and docstring."""
    import inspect

    sig, hints = inspect.signature(f), typing.get_type_hints(f)
    names = {str: "string", int: "integer", float: "number", bool: "boolean", dict: "object"}
    props, needed = {}, []
    for n, p in sig.parameters.items():
        h = _args(hints.get(n, str))[0][0]
        kind = "array" if typing.get_origin(h) is list else names.get(typing.get_origin(h) or h, "string")
        props[n] = {"type": kind}
        if p.default is inspect.Parameter.empty:
            needed.append(n)
    return {"name": f.__name__, "description": inspect.getdoc(f) or "", "parameters": {"type": "object", "properties": props, "required": needed}}


def expand_plan(plan: dict, library: dict[str, dict]) -> dict:
    """A plan with references to other plans replaced by them, each name once."""
    seen: set[str] = set()

    def go(p: dict) -> dict:
        seen.add(p["name"])
        deps = []
        for d in p.get("depends", []):
            full = library.get(d, {"name": d}) if isinstance(d, str) else d
            if full["name"] not in seen:
                deps.append(go(full))
        return {**p, "depends": deps}

    return go(plan)
