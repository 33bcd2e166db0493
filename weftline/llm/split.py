"""Oversized items in pieces under a limit, cut where the text pauses, with a fixed overlap.

A hierarchy of separators: section, paragraph, line, sentence, word, character. From the start of a piece the pack is
filled greedily up to the limit and ends at the last separator of the coarsest kind that leaves the piece at least
half full; if none does, at the last separator of the coarsest kind at all; a text without pauses is cut between
characters (never inside a CRLF, nor before a combining mark). The next piece starts exactly ``overlap`` characters
before the end of the last, so the pieces without their overlaps are the text again.

Edge cases: null and short contents are one piece; exactly the limit is one piece; repeated rows of an id count once;
null ids are skipped; an overlap that is not smaller than the limit is reduced to limit - 1.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.latest import latest_ids
from weftline.operators.numbering import number_rows

#: a piece ends where the match of its pattern ends, coarsest first
PAUSES = [
    ("section", re.compile(r"\n(?=#{1,6}[ \t])|\n(?=(?:[-*_] ?){3,}\n)")),
    ("paragraph", re.compile(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+")),
    ("line", re.compile(r"\r?\n")),
    ("sentence", re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』）”]*")),
    ("word", re.compile(r"\s+|[、，；]")),
]


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of each piece."""
    overlap = max(0, min(overlap, limit - 1))
    pieces, start, n = [], 0, len(text)
    while n - start > limit:
        low, half, high = start + overlap + 1, start + max(overlap + 1, limit // 2), start + limit
        end = 0
        for least in (half, low):
            for _, pattern in PAUSES:
                # a pause may reach beyond the window: only its end counts
                for m in pattern.finditer(text, least, high):
                    end = m.end()
                if end >= least:
                    break
                end = 0
            if end:
                break
        if not end:
            end = high
            while end > low and (unicodedata.combining(text[end]) or text[end] in "‍️" or (text[end] == "\n" and text[end - 1] == "\r")):
                end -= 1
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, n))
    return pieces


PIECES = "item_table string, item_id string, piece int, pieces int, start int, end int, content string"


def oversized(df: DataFrame, item_table: str, limit: int, version: str | None, content: str = "content", id_col: str = "id") -> DataFrame:
    """(item_table, item_id, content) of the current rows longer than ``limit``.

    Which delivery of an id is current is found on ids, lengths and hashes alone; only contents over the limit are shuffled.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.lower(id_col).alias("item_id"), (F.col(version) if version else F.lit(0)).alias("version"), F.col(content).alias("content"))
    narrow = rows.select("item_id", "version", F.coalesce(F.length("content"), F.lit(0)).alias("n"), F.xxhash64("content").alias("h"))
    big = latest_ids(narrow, "item_id", "version", [F.col("n"), F.col("h")]).where(F.col("n") > limit).select(F.col("item_id").alias("_i"), F.col("version").alias("_v"), F.col("h").alias("_h"))
    wide = rows.where(F.length("content") > limit).withColumn("h", F.xxhash64("content"))
    on = (F.col("item_id") == F.col("_i")) & F.col("version").eqNullSafe(F.col("_v")) & (F.col("h") == F.col("_h"))
    return wide.join(big, on, "left_semi").dropDuplicates(["item_id"]).select(F.lit(item_table).alias("item_table"), "item_id", "content")


def split_items(items: DataFrame, limit: int, overlap: int) -> DataFrame:
    """The pieces of (item_table, item_id, content): (item_table, item_id, piece from 0, pieces, start, end, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PIECES.split(", ")]
        for b in batches:
            take, cols = [], ([], [], [], [], [])
            for i, text in enumerate(b.column(2).to_pylist()):
                cuts = cut_points(text, limit, overlap) if text is not None else [(0, 0)]
                for k, (s, e) in enumerate(cuts):
                    take.append(i)
                    for c, v in zip(cols, (k, len(cuts), s, e, None if text is None else text[s:e]), strict=True):
                        c.append(v)
                if len(take) > 5000:
                    yield _pieces(b, take, cols, names)
                    take, cols = [], ([], [], [], [], [])
            yield _pieces(b, take, cols, names)

    return items.select("item_table", "item_id", "content").mapInArrow(run, PIECES)


def _pieces(b: pa.RecordBatch, take: list, cols: tuple, names: list[str]) -> pa.RecordBatch:
    idx = pa.array(take, pa.int64())
    return pa.RecordBatch.from_arrays([b.column(0).take(idx), b.column(1).take(idx), *[pa.array(c, pa.int32()) for c in cols[:4]], pa.array(cols[4], pa.string())], names=names)


def split_oversized(df: DataFrame, item_table: str, limits: DataFrame, version: str | None) -> DataFrame:
    """Pieces of every current item of ``df`` over the limit that ``limits`` (one row a table) gives for ``item_table``."""
    row = limits.where(F.col("item_table") == item_table).select("max_chars", "overlap_chars").first()
    if row is None:
        return df.sparkSession.createDataFrame([], PIECES)
    return split_items(oversized(df, item_table, row.max_chars, version), row.max_chars, row.overlap_chars)


def renumbered(df: DataFrame, pieces: DataFrame, parent: str, version: str | None, section: list[str] | None = None) -> DataFrame:
    """Every current item of ``df`` with new consecutive ``ordinal`` in its ``parent`` (and ``section_ordinal`` in its section).

    (item_id, piece, ordinal, section_ordinal), from 0, in the old order; an item that was cut takes one number a piece.
    """
    section = section or []
    narrow = df.where("id is not null").select(F.lower("id").alias("item_id"), (F.col(version) if version else F.lit(0)).alias("version"), F.col(parent).alias("parent"), F.col("ordinal").alias("old"), F.to_json(F.struct(*section)).alias("section") if section else F.lit("").alias("section"))
    now = latest_ids(narrow, "item_id", "version", [F.col("parent"), F.col("old"), F.col("section")])
    many = pieces.select("item_id", "piece")
    one = now.join(many.select("item_id").distinct(), "item_id", "left_anti").withColumn("piece", F.lit(0))
    rows = now.join(many, "item_id").unionByName(one).select("item_id", "piece", "parent", "old", "section")
    rows = number_rows(rows, ["parent"], ["old", "item_id", "piece"], out="ordinal")
    return number_rows(rows, ["parent", "section"], ["ordinal"], out="section_ordinal").select("item_id", "piece", "ordinal", "section_ordinal")
