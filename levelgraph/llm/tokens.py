"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_columns

#: Ranks of a byte-level BPE vocabulary; its path is a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern of that vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def counter(vocabulary: str):
    """A function from a text to its number of tokens. Strings of special tokens are ordinary text."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(own.encode_ordinary(text)) if text else 0


def token_counts(documents: DataFrame, *keep: str, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and ``tokens``: the length of each whole text. A null or empty text has 0 tokens."""
    require_columns(documents, text, *keep)
    slim = documents.select(*keep, F.col(text).alias("_text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            n = pa.array([count(t) for t in b.column("_text").to_pylist()], pa.int64())
            kept = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, n], names=[*keep, "tokens"])

    return slim.mapInArrow(run, f"{types}, tokens long")
