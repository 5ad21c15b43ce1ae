"""From texts to fixed-shape batches, and what either form costs to send."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.shape import batch_slices, clamp_batch_size, clamp_transfer, pad
from tokenmill.operators.accounts import TOKEN_BYTES
from tokenmill.operators.dictionary import Dictionary
from tokenmill.operators.greedy import greedy_encode
from tokenmill.operators.vocabulary import Vocabulary


def padded_batches(
    texts: DataFrame,
    vocab: Vocabulary,
    batch_size: int,
    keys: Sequence[str] = ("doc_id",),
    dictionary: Dictionary | None = None,
) -> DataFrame:
    """``batch_size`` rows per text: equal byte slices, each encoded on its
    own, cut or filled with 0 to ``seq_len`` tokens.

    ``cut_tokens`` counts the tokens beyond ``seq_len``, ``tail_bytes`` the
    bytes of the text that are in no slice. ``dictionary`` may be one that has
    all words of the slices."""
    slices = batch_slices(texts.select(*keys, "text"), batch_size)
    encoded = greedy_encode(slices, vocab, [*keys, "batch_idx"], dictionary, byte_view=True)
    return encoded.select(
        *keys,
        "batch_idx",
        "seq_len",
        pad(F.col("token_ids"), F.col("seq_len")).alias("token_ids"),
        F.greatest(F.size("token_ids") - F.col("seq_len"), F.lit(0)).alias("cut_tokens"),
        "tail_bytes",
    )


def transfer_modes(texts: DataFrame, batches: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Bytes per text sent as token IDs (mode A) and as text (mode B), each cut
    at the transfer limit."""
    ids = batches.groupBy(*keys).agg(
        F.sum(F.size("token_ids").cast("long") * TOKEN_BYTES).alias("n_bytes")
    )
    raw = texts.select(*keys, F.octet_length("text").cast("long").alias("n_bytes"))
    both = ids.withColumn("mode", F.lit("A")).unionByName(raw.withColumn("mode", F.lit("B")))
    return both.withColumn("sent_bytes", clamp_transfer(F.col("n_bytes")))


def batch_sweep(texts: DataFrame, sizes: Sequence[int], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For each text and batch size the sequence length, the IDs and bytes of
    the whole batch, and the bytes of the text that are in no slice."""
    n = F.octet_length("text").cast("long")
    each = F.floor(n / F.col("batch_size")).cast("long")
    swept = texts.select(
        *keys, "text", F.explode(F.array(*[F.lit(clamp_batch_size(s)) for s in sizes])).alias("batch_size")
    )
    return swept.select(
        *keys,
        "batch_size",
        F.floor(each / 4).cast("long").alias("seq_len"),
        (F.floor(each / 4) * F.col("batch_size")).cast("long").alias("n_ids"),
        (F.floor(each / 4) * F.col("batch_size") * TOKEN_BYTES).cast("long").alias("n_bytes"),
        (n % F.col("batch_size")).alias("tail_bytes"),
    )
