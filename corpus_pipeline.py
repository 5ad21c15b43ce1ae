"""Documents to token ids: rules, toxicity, near-duplicates, mix, encoding.

Each stage takes the documents its predecessor kept, and its decisions take
effect: ``run`` applies them one after the other, each stage's rows written to
the shared folder and read again. All but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm import bpe, mixing, ordermin, quality, toxicity
from tokenmill.llm.common import short_batches, table
from tokenmill.scratch import stored


def _numbered(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], dict[str, str]]:
    """The rows under names that no operator uses, those names, and the places
    of text and language among them."""
    short_batches(docs.sparkSession)
    names = tuple(f"__{i}" for i in range(len(docs.columns)))
    place = {c: names[docs.columns.index(c)] for c in ("text", "lang")}
    return docs.toDF(*names), names, {"text_col": place["text"], "lang_col": place["lang"]}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; the references are those of its input."""
    rows, names, places = _numbered(docs)
    return quality.quality_rules(rows, keep=names, **places).where("kept").select(*names).toDF(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold. The model learns from the
    labelled documents among them."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows, names, places = _numbered(docs)
    scored = toxicity.score(rows, model, keep=names, **places)
    return scored.where("not rejected").select(*names).toDF(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, that of the least id. Ids that
    come again with other texts lose none of them."""
    return ordermin.first_of_class(docs, one_per_id=False).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: once if it takes any word,
    twice if it takes more words than the document has. Documents without a
    word, which no word count can call for, stay once. Rows equal in id and text
    stay as often as the one of them that is taken most."""
    taken = mixing.taken_words(docs).groupBy("text_key").agg(F.max("taken").alias("taken"), F.first("size").alias("size"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size"))).cast("int")
    times = taken.select("text_key", times.alias("times"))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("text_key"))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")
    return rows.join(times, "text_key").select("row", copies).select("row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and ids of every document, and whether they decode to its text."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", digest.alias("digest"))
    ids = bpe.encode_texts(rows, ranks, public_tokenizers.PATTERN, keep=("doc_id", "digest"), decode=True)
    same = F.md5("decoded") == F.col("digest")
    return ids.select(
        "doc_id", F.size("ids").alias("n_tokens"), "ids", same.alias("round_trip")
    )


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: A trained model, sketches and a vocabulary decide; tests/llm compares the
#: stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage-{number}")
    return docs
