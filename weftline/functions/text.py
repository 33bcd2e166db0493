"""Text functions as Column expressions, and the chunkers that need a loop (as Arrow batch functions)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}]+"


def trigrams(c: Column) -> Column:
    """Set of trigrams of the words of a text, each padded with two spaces before and one behind."""
    words = F.regexp_extract_all(F.lower(c), F.lit(f"({WORDS})"), F.lit(1))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigrams_of(value: str) -> Column:
    """The trigrams of a plain string, made when the plan is built."""
    grams: dict[str, None] = {}
    for w in re.findall(r"[^\W_]+", value.lower()):
        padded = f"  {w} "
        grams.update((padded[i : i + 3], None) for i in range(len(w) + 1))
    return F.array(*[F.lit(g) for g in grams]) if grams else F.array().cast("array<string>")


def overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two sets of trigrams; 0 for two empty ones. Each side is evaluated once."""

    def share(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        either = F.size(x) + F.size(y) - both
        return F.when(either > 0, both / either).otherwise(F.lit(0.0))

    return F.transform(F.array(F.struct(a.alias("x"), b.alias("y"))), lambda p: share(p["x"], p["y"]))[0]


def similarity(a: Column, b: Column) -> Column:
    return overlap(trigrams(a), trigrams(b))


def contains_ci(c: Column, needle: str) -> Column:
    """Substring test without regard to case; wildcards in the needle are plain characters."""
    return F.instr(F.lower(c), needle.lower()) > 0


def html_to_text(c: Column) -> Column:
    """Markup stripped, white space collapsed."""
    s = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    for name, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        s = F.regexp_replace(s, f"&{name};", sign)
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def encode_url_query(pairs: Column) -> Column:
    """``k=v&...`` of a map of arrays; array values are joined by commas, nothing is percent-encoded, keys by (length, bytes)."""
    order = lambda a, b: F.when(F.length(a["key"]) != F.length(b["key"]), F.length(a["key"]) - F.length(b["key"])).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    entries = F.array_sort(F.map_entries(pairs), order)
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), "&")


def upload_metadata(header: Column) -> Column:
    """Map of a comma list of ``key base64`` pairs; pairs without a value get an empty one."""
    pairs = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    value = lambda p: F.when(F.size(F.split(p, " ")) > 1, F.decode(F.unbase64(F.element_at(F.split(p, " "), 2)), "UTF-8")).otherwise(F.lit(""))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.element_at(F.split(p, " "), 1).alias("key"), value(p).alias("value"))))


def fixed_chunks(df: DataFrame, text: str, size: int) -> DataFrame:
    """Rows with ``ordinal`` and ``chunk``: consecutive pieces of ``size`` characters. Null and empty texts give none."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), n - 1, F.lit(size))
    some = df.where(n > 0).withColumn("_s", F.explode(starts))
    return some.withColumn("ordinal", (F.col("_s") / size).cast("long")).withColumn("chunk", F.expr(f"substring({text}, _s + 1, {size})")).drop("_s")


def word_chunks(text: str, size: int = 1000, overlap_chars: int = 200) -> list[str]:
    """Overlapping chunks that end at the last space of the window."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n and (at := text.rfind(" ", start, end)) > start:
            end = at
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        if end >= n:
            break
        start = max(end - overlap_chars, start + 1)
    return out


_HEADING = re.compile(r"^(#{1,4})(?!#)\s*(.*)$")


def markdown_sections(text: str) -> list[tuple[int, int, int, list[str], str]]:
    """(ordinal, section_ordinal, level, path, content): paragraphs of a Markdown text under their headings of level 1-4."""
    path: list[tuple[int, str]] = []
    out: list[tuple[int, int, int, list[str], str]] = []
    counts: dict[tuple[str, ...], int] = {}
    body: list[str] = []

    def flush() -> None:
        key = tuple(t for _, t in path)
        for block in re.split(r"\n\s*\n", "\n".join(body)):
            if block.strip():
                out.append((len(out), counts.get(key, 0), path[-1][0] if path else 0, list(key), block.strip()))
                counts[key] = counts.get(key, 0) + 1
        body.clear()

    for line in text.splitlines():
        m = _HEADING.match(line)
        if m:
            flush()
            level = len(m.group(1))
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, m.group(2).strip()))
        else:
            body.append(line)
    flush()
    return out


def _exploded(df: DataFrame, key: str, text: str, f, schema: str, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for r in f(t) if t else ():
                    take.append(i)
                    rows.append(r)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *[pa.array(list(c), k) for c, (_, k) in zip(cols, fields, strict=True)]], names=[key, *[n for n, _ in fields]])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, {schema}")


def overlap_chunks(df: DataFrame, key: str, text: str, size: int = 1000, overlap_chars: int = 200) -> DataFrame:
    """(key, ordinal, chunk) by :func:`word_chunks`; no text is lost."""
    return _exploded(df, key, text, lambda t: list(enumerate(word_chunks(t, size, overlap_chars))), "ordinal long, chunk string", [("ordinal", pa.int64()), ("chunk", pa.string())])


def markdown_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, section_ordinal, level, path, content) by :func:`markdown_sections`."""
    return _exploded(df, key, text, markdown_sections, "ordinal long, section_ordinal long, level long, path array<string>, content string", [("ordinal", pa.int64()), ("section_ordinal", pa.int64()), ("level", pa.int64()), ("path", pa.list_(pa.string())), ("content", pa.string())])


def row_text(df: DataFrame, columns: list[str], sep: str = " | ") -> Column:
    """The columns of a row as one line of text, nulls empty."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
