"""Sizes of texts in tokens of a public byte-pair vocabulary."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pattern by which this vocabulary splits a text before merging
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], vocabulary: str = VOCABULARY) -> list[int]:
    """Tokens of each whole text; 0 for null. A lone surrogate is counted as a replacement sign."""
    encode = _encoder(vocabulary).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def with_token_counts(documents: DataFrame, text: Column, *, into: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``documents`` with a column ``into`` (bigint) added, whatever its other columns are called.

    The text itself is only read; leave it out of ``documents``' columns afterwards if it isn't needed.
    """
    columns = [f"_c{i}" for i in range(len(documents.columns))]
    names = documents.columns
    plain = documents.select(text.cast("string").alias("_text"), *[documents[f"`{n}`"].alias(c) for n, c in zip(names, columns, strict=True)])
    schema = T.StructType([*plain.schema.fields[1:], T.StructField("_n", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array(count_tokens(batch.column(0).to_pylist(), vocabulary), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sizes], names=[*columns, "_n"])

    counted = plain.mapInArrow(run, schema)
    return counted.select(*[counted[c].alias(n) for n, c in zip(names, columns, strict=True)], counted["_n"].alias(into))
