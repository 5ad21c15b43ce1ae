"""Fixed-shape batches: clamps, slices and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Limits of a payload in KB, of a batch and of one transfer.
PAYLOAD_KB = (1, 128)
BATCH_SIZE = (1, 32)
TRANSFER_BYTES = 65536


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def clamp_payload_kb(value: Column) -> Column:
    return clamp(value, *PAYLOAD_KB)


def clamp_batch_size(size: int) -> int:
    return max(BATCH_SIZE[0], min(size, BATCH_SIZE[1]))


def clamp_transfer(n_bytes: Column) -> Column:
    return F.least(n_bytes, F.lit(TRANSFER_BYTES))


def batch_slices(texts: DataFrame, batch_size: int) -> DataFrame:
    """Equal byte slices of every text: ``batch_idx``, ``seq_len`` (a quarter of
    the slice) and ``text`` as a byte view.

    The bytes beyond equal slices are in none of them; ``tail_bytes`` counts
    them. Sizes outside the limits are refused; clamp them before."""
    if clamp_batch_size(batch_size) != batch_size:
        raise ValueError(f"batch size {batch_size} is outside {BATCH_SIZE}")
    others = [c for c in texts.columns if c != "text"]
    each = F.floor(F.length("_bytes") / batch_size).cast("int")
    sliced = texts.select(*others, F.encode("text", "UTF-8").alias("_bytes")).withColumn(
        "batch_idx", F.explode(F.sequence(F.lit(0), F.lit(batch_size - 1)))
    )
    part = F.substring("_bytes", F.col("batch_idx") * each + 1, each)
    return sliced.select(
        *others,
        "batch_idx",
        F.floor(each / 4).cast("int").alias("seq_len"),
        (F.length("_bytes") % batch_size).alias("tail_bytes"),
        F.decode(part, "ISO-8859-1").alias("text"),
    )


def pad(token_ids: Column, length: Column) -> Column:
    """The first ``length`` IDs, filled up with 0."""
    cut = F.slice(token_ids, F.lit(1), length)
    return F.concat(cut, F.array_repeat(F.lit(0), length - F.size(cut)))
