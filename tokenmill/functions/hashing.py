"""Hash tokens: one token per four bytes of text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Start and factor of the 32-bit string hash and the two moduli
# in use, one per vocabulary size.
HASH_START = 5381
HASH_FACTOR = 33
BPE_MODULUS = 50257
WORDPIECE_MODULUS = 30522


def hashed(texts: pa.Array, modulus: int) -> pa.ListArray:
    """Tokens of a column of bytes: its buffer read as groups of four bytes, and
    the hash as one weighted sum of their columns."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    starts = offsets[:-1].astype(np.int64)
    counts = np.where(np.asarray(texts.is_valid()), np.diff(offsets) // 4, 0)
    ends = np.cumsum(counts)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 4 * np.arange(counts.sum()) + np.repeat(starts - 4 * (ends - counts), counts)
    value = np.full(len(first), HASH_START * HASH_FACTOR**4, dtype=np.int64)
    for place in range(4):
        value += data[first + place].astype(np.int64) * HASH_FACTOR ** (3 - place)
    tokens = (value % 2**32 % modulus).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(tokens))
    return lists if not texts.null_count else pc.if_else(texts.is_valid(), lists, pa.scalar(None, lists.type))


def hash_tokens(text: Column, modulus: int = BPE_MODULUS) -> Column:
    """Token IDs of the whole groups of four bytes; tail bytes are ignored. A
    null text gives null."""

    @F.arrow_udf("array<int>")
    def tokens(texts: pa.Array) -> pa.Array:
        return hashed(texts, modulus)

    return tokens(text.cast("binary"))
