"""Counting tokens and bytes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: bytes of one token ID.
TOKEN_BYTES = 4


def token_totals(encoded: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Texts and tokens per group, or of the whole corpus."""
    return encoded.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum(F.col("n_tokens").cast("long")).alias("n_tokens"),
        F.max("n_tokens").alias("max_tokens"),
    )


def compare_tokenizers(
    encoded: Mapping[str, DataFrame], keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Tokens per text, one column per algorithm."""
    parts = [
        df.select(*keys, F.lit(algo).alias("algo"), F.col("n_tokens").cast("long"))
        for algo, df in encoded.items()
    ]
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.groupBy(*keys).pivot("algo", list(encoded)).agg(F.sum("n_tokens"))


def transfer_sizes(text: Column, n_tokens: Column) -> dict[str, Column]:
    """Bytes as text and as token IDs."""
    return {
        "text_bytes": F.octet_length(text).cast("long"),
        "token_bytes": n_tokens.cast("long") * TOKEN_BYTES,
    }


def transfer_accounts(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``text_bytes`` and ``token_bytes`` summed per group, and their ratio."""
    return (
        rows.groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("n_texts"),
            F.sum("text_bytes").alias("text_bytes"),
            F.sum("token_bytes").alias("token_bytes"),
        )
        .withColumn("ratio", F.col("token_bytes") / F.col("text_bytes"))
    )
