"""Embedding texts with an injected model; offline a deterministic hashing model stands in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.ids import jsonb_uuid

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Bag of words in ``dim`` signed buckets, unit length: the same everywhere, no model needed."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(out[i])
            if n:
                out[i] /= n
        return out.tolist()

    return embed


def embed_texts(requests: DataFrame, embedder: Embedder, batch: int = 200) -> DataFrame:
    """The rows of ``requests`` (with ``description``) and their ``embedding``, in batches of at most ``batch``; order plays no part."""
    schema = requests.withColumn("embedding", F.array(F.lit(0.0).cast("float"))).schema
    at = requests.columns.index("description")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                vectors = embedder([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*part.schema.names, "embedding"])

    return requests.mapInArrow(run, schema)


def embedding_records(requests: DataFrame, embedder: Embedder) -> DataFrame:
    """Rows for the embedding table, with ids that depend only on source, column and model."""
    named = requests.where("source_id is not null")
    ident = jsonb_uuid({"column_name": (F.col("column_name"), "string"), "embedding_id": (F.col("embedding_name"), "string"), "source_record_id": (F.col("source_id"), "string")})
    return embed_texts(named.withColumn("id", ident), embedder).select("id", F.col("source_id").alias("source_record_id"), "column_name", F.col("embedding").alias("embedding_vector"), "embedding_name")
