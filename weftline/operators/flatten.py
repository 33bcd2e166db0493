"""Deeply nested JSON columns as flat tables with parent links, by array kernels instead of row parsing.

The JSON texts of an Arrow batch, up to SLICE_BYTES at once, are one byte buffer. Quotes, brackets, commas and colons are found in that buffer
with vector operations; nesting depth is a running sum, the parent of every token is found level by level from the
sorted positions of the opening brackets (list offsets), and paths and keys travel down the levels with ``take``.
No text is parsed row by row. Text that is not valid JSON yields nothing. A string value that is itself JSON of an
object, array or string (after trimming) is opened in a further round over the strings found, and adds nothing to
the path.

Edge cases: null, empty or invalid text gives no row; an empty table gives an empty table; the outermost value is
never a row; with a repeated key in one object the rows of all its values are listed, each path once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LBRACE, RBRACE, LBRACK, RBRACK, COMMA, COLON, STRING, SCALAR = range(8)
_KIND = np.full(256, -1, np.int8)
for _i, _c in enumerate(b"{}[],:"):
    _KIND[_c] = _i
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r")] = True
_NUMBER = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"
_ESCAPES = r'^(?s:(?:[^\\]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*)$'

#: bytes of texts that one buffer holds
SLICE_BYTES = 8 << 20

NODE_SCHEMA = "src_field string, record_id string, node_path string, parent_path string, node_key string, node_index long, depth int"
MEMBER_SCHEMA = "src_field string, record_id string, node_path string, member_path string, kind string, value string"


def _strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The slices [start, end) of the buffer as an Arrow string array, gathered with one take."""
    length = (end - start).astype(np.int64)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    index = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    data = buf[index] if len(index) else np.empty(0, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Tokens:
    """The tokens of a batch of JSON texts, with level, parent, record and validity."""

    def __init__(self, texts: pa.Array):
        buf, offsets = _bytes_of(texts)
        self.buf, n_rec = buf, len(offsets) - 1
        starts = offsets[:-1]
        self.valid = offsets[1:] > starts
        quote = np.flatnonzero(buf == 34)
        if len(quote):
            back = buf == 92
            if back.any():
                last = np.maximum.accumulate(np.where(back, -1, np.arange(len(buf))))
                before = np.where(quote > 0, last[quote - 1], -1)
                rec_q = np.searchsorted(offsets, quote, "right") - 1
                run = np.minimum(quote - 1 - before, quote - starts[rec_q])
                quote = quote[run % 2 == 0]
        rec_q = np.searchsorted(offsets, quote, "right") - 1
        per_rec = np.bincount(rec_q, minlength=n_rec)
        self.valid &= per_rec % 2 == 0
        first = np.concatenate([[0], np.cumsum(per_rec)])[:-1]
        opening = (np.arange(len(quote)) - first[rec_q]) % 2 == 0
        ok = self.valid[rec_q]
        s_open, s_close = quote[opening & ok], quote[~opening & ok]
        edge = np.zeros(len(buf) + 1, np.int32)
        edge[s_open] += 1
        edge[s_close + 1] -= 1
        inside = np.cumsum(edge[:-1]) > 0
        bad_rec = np.repeat(~self.valid, np.diff(offsets))
        control = np.flatnonzero(inside & (buf < 32))
        if len(control):
            self.valid[np.searchsorted(offsets, control, "right") - 1] = False
        free = ~inside & ~bad_rec
        struct = np.flatnonzero(free & (_KIND[buf] >= 0))
        word = free & (_KIND[buf] < 0) & ~_SPACE[buf]
        at = np.zeros(len(buf) + 1, bool)
        at[offsets[:-1][offsets[:-1] < len(buf)]] = True
        left = np.concatenate([[False], word[:-1]]) if len(word) else word
        w_start = np.flatnonzero(word & (~left | at[:-1]))
        right = np.concatenate([word[1:], [False]]) if len(word) else word
        w_end = np.flatnonzero(word & (~right | at[1:])) + 1
        pos = np.concatenate([struct, s_open, w_start])
        end = np.concatenate([struct + 1, s_close + 1, w_end])
        kind = np.concatenate([_KIND[buf[struct]] if len(struct) else np.empty(0, np.int8), np.full(len(s_open), STRING, np.int8), np.full(len(w_start), SCALAR, np.int8)])
        order = np.argsort(pos, kind="stable")
        self.pos, self.end, self.kind = pos[order], end[order], kind[order].astype(np.int64)
        self.rec = np.searchsorted(offsets, self.pos, "right") - 1
        self._nest(n_rec)
        self._check(n_rec)

    def _nest(self, n_rec: int) -> None:
        kind, rec = self.kind, self.rec
        n = len(kind)
        opens, closes = (kind == LBRACE) | (kind == LBRACK), (kind == RBRACE) | (kind == RBRACK)
        step = opens.astype(np.int64) - closes
        total = np.cumsum(step)
        new = np.concatenate([[True], rec[1:] != rec[:-1]]) if n else np.empty(0, bool)
        first = np.flatnonzero(new)
        base = np.repeat((total - step)[first], np.diff(np.append(first, n))) if n else total
        after = total - base
        #: level of an opening bracket is the depth outside it; a closing one has the level of its partner
        self.level = np.where(opens, after - 1, after)
        last = np.append(first[1:], n) - 1 if n else first
        bad = np.zeros(n_rec, bool)
        if n:
            bad[rec[last][after[last] != 0]] = True
            bad[rec[self.level < 0]] = True
        self.valid &= ~bad
        present = np.zeros(n_rec, bool)
        present[rec] = True
        self.valid &= present
        self.parent = np.full(n, -1, np.int64)
        self.partner = np.full(n, -1, np.int64)
        live = self.valid[rec] if n else np.empty(0, bool)
        by_level = np.argsort(np.where(live, self.level, -1), kind="stable")
        levels = self.level[by_level]
        lo = np.searchsorted(np.where(live, self.level, -1)[by_level], 0)
        by_level, levels = by_level[lo:], levels[lo:]
        self.top = int(levels[-1]) if len(levels) else -1
        cuts = np.searchsorted(levels, np.arange(self.top + 2))
        self.at_level = [by_level[cuts[i] : cuts[i + 1]] for i in range(self.top + 1)]
        for lv in range(self.top + 1):
            idx = self.at_level[lv]
            if lv:
                up = self.at_level[lv - 1]
                up = up[opens[up]]
                self.parent[idx] = up[np.searchsorted(up, idx) - 1]
            o, c = idx[opens[idx]], idx[closes[idx]]
            self.partner[c] = o[np.searchsorted(o, c) - 1] if len(o) else -1
        self.opens, self.closes, self.live = opens, closes, live

    def _check(self, n_rec: int) -> None:
        kind, rec, n = self.kind, self.rec, len(self.kind)
        if not n:
            self.is_key = np.empty(0, bool)
            return
        same = np.concatenate([[False], rec[1:] == rec[:-1]])
        prev = np.where(same, np.concatenate([[-1], kind[:-1]]), -1)
        nxt = np.where(np.append(same[1:], False), np.append(kind[1:], -1), -1)
        box = np.where(self.parent >= 0, kind[self.parent], -1)
        in_obj, in_arr, root = box == LBRACE, box == LBRACK, box == -1
        self.is_key = (kind == STRING) & in_obj & ((prev == LBRACE) | (prev == COMMA))
        key_before = np.concatenate([[False], self.is_key[:-1]]) & same
        value = (kind == STRING) | (kind == SCALAR) | self.opens
        ended = ((prev == STRING) | (prev == SCALAR) | (prev == RBRACE) | (prev == RBRACK)) & ~key_before
        good = np.ones(n, bool)
        good &= np.where(value & in_obj & ~self.is_key, prev == COLON, True)
        good &= np.where(value & in_arr, (prev == LBRACK) | (prev == COMMA), True)
        good &= np.where(value & root, prev == -1, True)
        good &= np.where(self.is_key, nxt == COLON, True)
        good &= np.where(kind == COLON, key_before & in_obj, True)
        good &= np.where(kind == COMMA, ended & ~root, True)
        good &= np.where(kind == RBRACE, ((prev == LBRACE) | ended) & (kind[self.partner] == LBRACE), True)
        good &= np.where(kind == RBRACK, ((prev == LBRACK) | ended) & (kind[self.partner] == LBRACK), True)
        self.valid[rec[~good & self.live]] = False
        scalar = np.flatnonzero((kind == SCALAR) & self.live)
        if len(scalar):
            ok = pc.match_substring_regex(_strings(self.buf, self.pos[scalar], self.end[scalar]), _NUMBER).to_numpy(zero_copy_only=False)
            self.valid[rec[scalar[~ok]]] = False
        text = np.flatnonzero((kind == STRING) & self.live)
        if len(text):
            back = np.concatenate([[0], np.cumsum(self.buf == 92)])
            text = text[back[self.end[text]] > back[self.pos[text]]]
        if len(text):
            ok = pc.match_substring_regex(_strings(self.buf, self.pos[text] + 1, self.end[text] - 1), _ESCAPES).to_numpy(zero_copy_only=False)
            self.valid[rec[text[~ok]]] = False

    def text(self, idx: np.ndarray) -> pa.Array:
        """Contents of string tokens, unescaped."""
        out = _strings(self.buf, self.pos[idx] + 1, self.end[idx] - 1)
        esc = np.flatnonzero(pc.match_substring(out, "\\").to_numpy(zero_copy_only=False)) if len(out) else []
        if len(esc):
            values = out.to_pylist()
            for i in esc:
                values[i] = json.loads(f'"{values[i]}"').encode("utf-8", "replace").decode()
            out = pa.array(values, pa.large_string())
        return out


def _join(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts], pa.scalar("", pa.large_string()))


def _suffixes(t: Tokens, idx: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Path suffix, key and array index of the value tokens ``idx``, all of one level above 0 and sorted."""
    level = t.at_level[t.level[idx[0]]]
    commas = np.cumsum(t.kind[level] == COMMA)
    parents = t.parent[level]
    first = np.searchsorted(parents, t.parent[idx])
    here = np.searchsorted(level, idx)
    base = commas[first] - (t.kind[level[first]] == COMMA)
    number = commas[here] - base
    in_arr = t.kind[t.parent[idx]] == LBRACK
    suffix = _join("[", pc.cast(pa.array(number), pa.large_string()), "]")
    key = pa.nulls(len(idx), pa.large_string())
    if not in_arr.all():
        keys = t.text(idx[~in_arr] - 2)
        take = pa.array(np.where(in_arr, 0, np.cumsum(~in_arr) - 1))
        key = pc.if_else(pa.array(in_arr), pa.scalar(None, pa.large_string()), keys.take(take))
        suffix = pc.if_else(pa.array(in_arr), suffix, _join(".", key))
    return suffix, key, pc.if_else(pa.array(in_arr), pa.array(number, pa.int64()), pa.scalar(None, pa.int64()))


def flatten_batch(texts: pa.Array, members: bool = False) -> dict[str, pa.Array]:
    """Rows of the nested objects (or, with ``members``, of the plain values) of a batch; ``row`` is the index of the text."""
    parts: list[dict] = []
    row = np.flatnonzero(pc.is_valid(texts).to_numpy(zero_copy_only=False))
    prefix = pa.array(np.full(len(row), "$"), pa.large_string())
    owner, outer = prefix, np.ones(len(row), bool)
    depth0 = np.zeros(len(row), np.int64)
    key0, index0 = pa.nulls(len(row), pa.large_string()), pa.nulls(len(row), pa.int64())
    texts = texts.take(pa.array(row))
    while len(row):
        t = Tokens(pc.utf8_trim_whitespace(texts))
        values = t.valid[t.rec] & (t.opens | (((t.kind == STRING) | (t.kind == SCALAR)) & ~t.is_key)) if len(t.rec) else np.empty(0, bool)
        nxt: list[tuple] = []
        up_path = up_owner = None
        up_idx = np.empty(0, np.int64)
        for lv in range(t.top + 1):
            idx = t.at_level[lv]
            idx = idx[values[idx]]
            if not len(idx):
                break
            rec = pa.array(t.rec[idx])
            if lv == 0:
                path, own, key, number = prefix.take(rec), owner.take(rec), key0.take(rec), index0.take(rec)
            else:
                above = pa.array(np.searchsorted(up_idx, t.parent[idx]))
                suffix, key, number = _suffixes(t, idx)
                path = _join(up_path.take(above), suffix)
                own = up_owner.take(above)
            kind = t.kind[idx]
            depth = depth0[t.rec[idx]] + lv
            emit = ((kind == LBRACE) & ((lv > 0) | ~outer[t.rec[idx]])) if not members else np.zeros(len(idx), bool)
            inner = np.flatnonzero(kind == STRING)
            plain = kind == SCALAR
            if len(inner):
                content = pc.utf8_trim_whitespace(t.text(idx[inner]))
                maybe = pc.match_substring_regex(content, r'^[{\["]').to_numpy(zero_copy_only=False)
                opened = inner[maybe]
                if len(opened):
                    inside = content.filter(pa.array(maybe))
                    ok = Tokens(inside).valid
                    opened, inside = opened[ok], inside.filter(pa.array(ok))
                    pick = pa.array(opened)
                    nxt.append((row[t.rec[idx[opened]]], path.take(pick), own.take(pick), outer[t.rec[idx[opened]]] & (lv == 0), depth[opened], key.take(pick), number.take(pick), inside))
                plain |= kind == STRING
                plain[opened] = False
            if members:
                emit = plain
            if emit.any():
                m = pa.array(np.flatnonzero(emit))
                part = {"row": row[t.rec[idx[emit]]], "path": path.take(m), "owner": own.take(m), "key": key.take(m), "index": number.take(m), "depth": depth[emit]}
                if members:
                    sel = idx[emit]
                    quoted = t.kind[sel] == STRING
                    raw = _strings(t.buf, t.pos[sel], t.end[sel])
                    if quoted.any():
                        raw = pc.if_else(pa.array(quoted), t.text(sel[quoted]).take(pa.array(np.where(quoted, np.cumsum(quoted) - 1, 0))), raw)
                    part |= {"value": raw, "kind": pa.array(np.where(quoted, "string", np.where(np.isin(t.buf[t.pos[sel]], list(b"tf")), "boolean", np.where(t.buf[t.pos[sel]] == ord("n"), "null", "number"))))}
                parts.append(part)
            box = np.flatnonzero(t.opens[idx])
            up_idx = idx[box]
            up_path = path.take(pa.array(box))
            up_owner = pc.if_else(pa.array(t.kind[up_idx] == LBRACE), up_path, own.take(pa.array(box)))
        if not nxt:
            break
        row = np.concatenate([x[0] for x in nxt])
        outer, depth0 = np.concatenate([x[3] for x in nxt]), np.concatenate([x[4] for x in nxt])
        prefix, owner, key0, index0, texts = (pa.concat_arrays([x[i].cast(kind) for x in nxt]) for i, kind in ((1, pa.large_string()), (2, pa.large_string()), (5, pa.large_string()), (6, pa.int64()), (7, pa.large_string())))
    names = ["row", "path", "owner", "key", "index", "depth"] + ["value", "kind"] * members
    kinds = {"row": pa.int64(), "index": pa.int64(), "depth": pa.int32()}
    return {c: pa.chunked_array([pa.array(p[c]).cast(kinds.get(c, pa.string())) for p in parts], kinds.get(c, pa.string())).combine_chunks() for c in names}


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """[from, to) of stretches of at most ``most`` bytes; a longer text is one by itself. The kernels need some 40 bytes a byte."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, lo = np.concatenate([[0], np.cumsum(size)]), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def _flatten(df: DataFrame, record: str, fields: Sequence[tuple[str, str]], members: bool, schema: str) -> DataFrame:
    columns = [c for c, _ in fields]
    names = dict(fields)
    narrow = df.select(F.col(record).cast("string").alias("record_id"), *[F.col(c).cast("string").alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for i, c in enumerate(columns):
                texts = b.column(i + 1)
                for lo, hi in slices(texts):
                    f = flatten_batch(texts.slice(lo, hi - lo), members)
                    field = pa.array(np.full(len(f["row"]), names[c]), pa.string())
                    rec = ids.slice(lo, hi - lo).take(f["row"])
                    if members:
                        out = [field, rec, f["owner"], f["path"], f["kind"], f["value"]]
                    else:
                        out = [field, rec, f["path"], f["owner"], f["key"], f["index"], f["depth"]]
                    yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], names=[x.split()[0] for x in schema.split(", ")])

    return narrow.mapInArrow(run, schema)


def flatten_objects(df: DataFrame, record: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """One row for each JSON object nested in the columns ``fields`` [(column, name in the result), ...].

    Linked to its record by ``record_id`` and to the nearest enclosing object by ``parent_path``. See the module text.
    """
    return _flatten(df, record, fields, False, NODE_SCHEMA)


def flatten_members(df: DataFrame, record: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """One row for each plain value in the columns, linked to the object that holds it (``node_path``): the child tables' cells."""
    return _flatten(df, record, fields, True, MEMBER_SCHEMA)
