"""A small Cypher front end over node and edge frames.

MATCH patterns with labels, inline properties, directions, types and bounded lengths (``*1..3``), several patterns
separated by commas, WHERE, WITH ... WHERE, RETURN with grouping, ORDER BY and LIMIT. Patterns become equi-joins,
expressions become SQL expressions; nothing is interpreted row by row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import steps

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+(?:\.\d+)?)|(?P<range>\.\.)|(?P<name>[A-Za-z_]\w*)|(?P<op><-|->|<>|<=|>=|[-(){}\[\]:,.*=<>+/|]))")


class CypherError(ValueError):
    pass


@dataclass
class NodePattern:
    var: str
    label: str | None = None
    props: dict[str, str] = field(default_factory=dict)


@dataclass
class RelPattern:
    var: str | None
    types: list[str]
    least: int
    most: int
    direction: str  # out, in, both


@dataclass
class PathPattern:
    var: str | None
    nodes: list[NodePattern]
    rels: list[RelPattern]


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[str] = []
        at = 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise CypherError(f"cannot read {text[at : at + 20]!r}")
            self.tokens.append(m.group().strip())
            at = m.end()
        self.i, self.anon = 0, 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.i + k] if self.i + k < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if not t or (want is not None and t.upper() != want.upper()):
            raise CypherError(f"expected {want or 'more'}, found {t or 'the end'}")
        self.i += 1
        return t

    def word(self, w: str) -> bool:
        return self.peek().upper() == w

    def fresh(self) -> str:
        self.anon += 1
        return f"_x{self.anon}"

    def props(self) -> dict[str, str]:
        out = {}
        if self.peek() == "{":
            self.take()
            while self.peek() != "}":
                k = self.take()
                self.take(":")
                out[k] = self.take()
                if self.peek() == ",":
                    self.take()
            self.take("}")
        return out

    def node(self) -> NodePattern:
        self.take("(")
        var = self.take() if re.match(r"[A-Za-z_]", self.peek()) else self.fresh()
        label = None
        if self.peek() == ":":
            self.take()
            label = self.take()
        p = self.props()
        self.take(")")
        return NodePattern(var, label, p)

    def rel(self) -> RelPattern:
        left = self.take() == "<-"
        var, types, least, most = None, [], 1, 1
        if self.peek() == "[":
            self.take()
            if re.match(r"[A-Za-z_]", self.peek()):
                var = self.take()
            if self.peek() == ":":
                self.take()
                types.append(self.take())
                while self.peek() == "|":
                    self.take()
                    if self.peek() == ":":
                        self.take()
                    types.append(self.take())
            if self.peek() == "*":
                self.take()
                least, most = 1, 3
                if self.peek().isdigit():
                    least = most = int(self.take())
                if self.peek() == "..":
                    self.take()
                    most = int(self.take())
            self.take("]")
        end = self.take()
        if end not in ("-", "->"):
            raise CypherError("a relationship ends with - or ->")
        return RelPattern(var, types, least, most, "in" if left else "out" if end == "->" else "both")

    def path(self) -> PathPattern:
        var = None
        if self.peek(1) == "=":
            var = self.take()
            self.take("=")
        nodes, rels = [self.node()], []
        while self.peek() in ("-", "<-"):
            rels.append(self.rel())
            nodes.append(self.node())
        return PathPattern(var, nodes, rels)

    def until(self, *words: str) -> list[str]:
        out, depth = [], 0
        while self.peek() and not (depth == 0 and self.peek().upper() in words):
            t = self.take()
            depth += (t in "([{") - (t in ")]}")
            out.append(t)
        return out

    @staticmethod
    def split(tokens: list[str]) -> list[list[str]]:
        out: list[list[str]] = [[]]
        depth = 0
        for t in tokens:
            depth += (t in "([{") - (t in ")]}")
            if t == "," and depth == 0:
                out.append([])
            else:
                out[-1].append(t)
        return [x for x in out if x]


_AGGREGATES = {"count", "collect", "sum", "avg", "min", "max"}


class Cypher:
    """Runs queries over ``nodes`` and ``edges`` as described in the graph operators."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def _node(self, n: NodePattern) -> DataFrame:
        df = self.nodes
        if n.label:
            df = df.where(F.col("label") == n.label)
        for k, v in n.props.items():
            value = v[1:-1] if v[0] in "'\"" else v
            df = df.where((F.col("key") if k in ("name", "key") else F.col("user_id") if k == "user_id" else F.col("props")[k]) == value)
        return df.select(F.struct("id", "label", "key", "user_id", "props").alias(n.var), F.col("id").alias(f"{n.var}__id"))

    def _rel(self, r: RelPattern, a: str, b: str, path: str, with_struct: bool) -> DataFrame:
        e = self.edges if not r.types else self.edges.where(F.col("rel_type").isin(*r.types))
        if r.direction == "in":
            e = e.withColumns({"src": F.col("dst"), "dst": F.col("src")})
        st = steps(e, r.direction != "both")
        out, front = None, st.select(F.col("a").alias("x"), F.col("b").alias("y"), F.array("eid").alias("used"))
        for n in range(1, r.most + 1):
            if n > 1:
                front = front.join(st, F.col("y") == F.col("a")).where(~F.array_contains("used", F.col("eid"))).select("x", F.col("b").alias("y"), F.concat("used", F.array("eid")).alias("used"))
            if n >= r.least:
                out = front if out is None else out.unionByName(front)
        out = out.select(F.col("x").alias(f"{a}__from"), F.col("y").alias(f"{b}__to"), F.col("used").alias(f"{path}__used"))
        if with_struct:
            s = self.edges.select(F.struct("id", "src", "dst", "rel_type", "created_at", "terminated_at", "props").alias(r.var), F.col("id").alias("_eid"))
            out = out.join(s, F.col(f"{path}__used")[0] == F.col("_eid")).drop("_eid")
        return out

    def _match(self, paths: list[PathPattern]) -> tuple[DataFrame, dict[str, str]]:
        df, seen, kinds = None, set(), {}
        for p in paths:
            if p.nodes[0].var not in seen and p.nodes[-1].var in seen:  # read from the end that is known
                turn = {"out": "in", "in": "out", "both": "both"}
                p = PathPattern(p.var, p.nodes[::-1], [RelPattern(r.var, r.types, r.least, r.most, turn[r.direction]) for r in p.rels[::-1]])
            used: list[str] = []
            for i, n in enumerate(p.nodes):
                kinds[n.var] = "node"
                if i == 0:
                    if n.var not in seen:
                        if df is not None:
                            raise CypherError("patterns without a common variable would be a product of all their matches")
                        df = self._node(n)
                        seen.add(n.var)
                    continue
                r, prev = p.rels[i - 1], p.nodes[i - 1]
                name = f"_r{len(kinds)}_{i}"
                single = r.var is not None and r.most == 1
                if r.var:
                    kinds[r.var] = "rel" if single else "rels"
                e = self._rel(r, prev.var, n.var, name, single)
                df = df.join(e, F.col(f"{prev.var}__id") == F.col(f"{prev.var}__from")).drop(f"{prev.var}__from")
                if n.var in seen:
                    df = df.where(F.col(f"{n.var}__id") == F.col(f"{n.var}__to")).drop(f"{n.var}__to")
                else:
                    df = df.join(self._node(n), F.col(f"{n.var}__to") == F.col(f"{n.var}__id")).drop(f"{n.var}__to")
                    seen.add(n.var)
                if r.var and not single:
                    df = df.withColumn(r.var, F.col(f"{name}__used"))
                used.append(f"{name}__used")
            if len(used) > 1:
                whole = F.concat(*used)
                df = df.where(F.size(F.array_distinct(whole)) == F.size(whole))
            if p.var:
                kinds[p.var] = "path"
                df = df.withColumn(p.var, F.struct((F.size(F.concat(*used)) if used else F.lit(0)).cast("long").alias("length"), F.concat(*used).alias("relationships") if used else F.array().cast("array<bigint>").alias("relationships"), F.array(*[F.col(x.var) for x in p.nodes]).alias("nodes")))
        return df, kinds

    def _sql(self, tokens: list[str], kinds: dict[str, str]) -> str:
        out, i = [], 0
        while i < len(tokens):
            t = tokens[i]
            low = t.lower()
            if low in ("id", "type", "properties", "length", "nodes", "relationships") and i + 3 < len(tokens) + 1 and tokens[i + 1 : i + 2] == ["("] and tokens[i + 3 : i + 4] == [")"]:
                v = tokens[i + 2]
                part = {"id": "id", "type": "rel_type", "properties": "props", "length": "length", "nodes": "nodes", "relationships": "relationships"}[low]
                out.append(f"`{v}`.{part}")
                i += 4
            elif t in kinds and tokens[i + 1 : i + 2] == ["."] and i + 2 < len(tokens):
                p = tokens[i + 2]
                column = {"name": "key", "key": "key", "id": "id", "label": "label", "user_id": "user_id", "rel_type": "rel_type", "created_at": "created_at", "terminated_at": "terminated_at"}.get(p)
                out.append(f"`{t}`.{column}" if column else f"`{t}`.props['{p}']")
                i += 3
            elif t in kinds:
                out.append(f"`{t}`")
                i += 1
            elif low == "collect":
                out.append("collect_list")
                i += 1
            elif t == "[":
                out.append("(")
                i += 1
            elif t == "]":
                out.append(")")
                i += 1
            elif t[0] in "'\"":
                out.append("'" + t[1:-1].replace("'", "\\'") + "'")
                i += 1
            else:
                out.append(t)
                i += 1
        return " ".join(out)

    def _project(self, df: DataFrame, tokens: list[str], kinds: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
        distinct = tokens[:1] and tokens[0].upper() == "DISTINCT"
        items = []
        for it in _Parser.split(tokens[1:] if distinct else tokens):
            name = "_".join(x for x in it if re.match(r"\w", x) and x[0] not in "'\"") or "value"
            if len(it) > 2 and it[-2].upper() == "AS":
                name, it = it[-1], it[:-2]
            agg = any(x.lower() in _AGGREGATES and it[k + 1 : k + 2] == ["("] for k, x in enumerate(it))
            items.append((name, self._sql(it, kinds), agg, kinds.get(it[0]) if len(it) == 1 else None))
        if any(a for _, _, a, _ in items):
            keys = [F.expr(e).alias(n) for n, e, a, _ in items if not a]
            df = df.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e, a, _ in items if a]).select(*[n for n, _, _, _ in items])
        else:
            df = df.select(*[F.expr(e).alias(n) for n, e, _, _ in items])
        if distinct:
            df = df.distinct()
        return df, {n: k or "value" for n, _, _, k in items}

    def run(self, query: str) -> DataFrame:
        p = _Parser(query)
        p.take("MATCH")
        paths = [p.path()]
        while p.peek() == ",":
            p.take()
            paths.append(p.path())
        df, kinds = self._match(paths)
        while p.peek():
            if p.word("WHERE"):
                p.take()
                df = df.where(self._sql(p.until("WITH", "RETURN", "ORDER", "LIMIT"), kinds))
            elif p.word("WITH"):
                p.take()
                df, kinds = self._project(df, p.until("WHERE", "RETURN", "ORDER", "LIMIT"), kinds)
            elif p.word("RETURN"):
                p.take()
                df, kinds = self._project(df, p.until("ORDER", "LIMIT"), kinds)
            elif p.word("ORDER"):
                p.take()
                p.take("BY")
                keys = []
                for k in _Parser.split(p.until("LIMIT", "RETURN", "WHERE")):
                    down = k[-1].upper() == "DESC"
                    e = self._sql(k[:-1] if k[-1].upper() in ("DESC", "ASC") else k, kinds)
                    keys.append(F.expr(e).desc() if down else F.expr(e).asc())
                df = df.orderBy(*keys)
            elif p.word("LIMIT"):
                p.take()
                df = df.limit(int(p.take()))
            else:
                raise CypherError(f"cannot read {p.peek()!r}")
        return df


def cypher_query(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """(result): each row of the query as one JSON object."""
    return Cypher(nodes, edges).run(query).select(F.to_json(F.struct("*")).alias("result"))
