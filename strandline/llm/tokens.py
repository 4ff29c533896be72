"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rank file of a byte-level vocabulary; any other is given by its path.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that cuts text into pieces before the merges of byte-level rank files.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(ranks: str):
    """The tokenizer of a rank file, once per Python worker."""
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=merges, special_tokens={})


def token_sizes(docs: DataFrame, key: str, text: str, keep: list[str] | None = None, ranks: str = RANKS) -> DataFrame:
    """(*key, *keep, tokens bigint) of every row; whole texts, null and empty ones have 0 tokens."""
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], names=[*batch.schema.names[1:], "tokens"])

    kinds = dict(docs.dtypes)
    names = [key, *keep]
    slim = docs.select(F.col(text).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    made = slim.mapInArrow(run, ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(names)) + ", tokens bigint")
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "tokens")
