"""Registered queries of this subpackage; tables are read whole."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm import (
    alignment,
    bpe,
    extraction,
    idfiles,
    mixing,
    multiindex,
    ordermin,
    ordinal,
    packing,
    quality,
    sharding,
    spelling,
    toxicity,
)
from tokenmill.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    ids = bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN, keep=("doc_id",), decode=True)
    return ids.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents")).drop("text_key")


def op3_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = multiindex.sign_codes(table(spark, sf_dir, "embeddings"))
    return multiindex.nearest(codes, codes.where("id % 20 = 0"), k=10)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.classes(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extraction.extract(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return idfiles.id_digests(table(spark, sf_dir, "documents"), tokenizer, end_id=2)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.cross_aligned(table(spark, sf_dir, "documents"), first, second)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer, end_id=0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_mixing,
        op3_divergence_rules,
        op4_multi_index,
        op5_order_minhash,
        op6_toxicity,
        op7_main_text,
        op8_ordinal_quality,
        op9_histogram_sort,
        op10_id_files,
        op11_alignment,
        op12_packing,
        op13_spelling_variants,
    )
}
ORACLES: dict[str, str] = {
    "op4_multi_index": """
        WITH codes AS (
            SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        ), pairs AS (
            SELECT a.vec_id AS query_id, b.vec_id AS id,
                   min(len(list_filter(list_zip(a.bits, b.bits), lambda z: z[1] <> z[2]))) AS distance
            FROM codes a JOIN codes b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, id, CAST(distance AS INTEGER) AS distance
        FROM ranked WHERE rank <= 10
    """,
}
