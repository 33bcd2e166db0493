"""Sizes of texts in tokens of a public tokenizer. The vocabulary file is read where it lies, never copied."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-splitting pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZERS, name: str = VOCABULARY):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, keep: list[str], folder: str = TOKENIZERS, out: str = "n_tokens") -> DataFrame:
    """``keep`` and the number of tokens of ``text``; null text has null tokens, empty text none. Special tokens count as plain text."""
    narrow = df.select(*keep, F.col(text).alias("_text"))
    schema = narrow.drop("_text").withColumn(out, F.lit(0).cast("long")).schema
    schema[out].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder)
        for b in batches:
            n = [None if t is None else len(enc.encode_ordinary(t)) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], names=[*keep, out])

    return narrow.mapInArrow(run, schema)
