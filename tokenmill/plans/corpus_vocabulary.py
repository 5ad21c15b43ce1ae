"""Vocabularies derived from a corpus, for corpora without vocabulary files.

Counts are stored once: the texts are split in one pass, and what asks a table of
counts again (its histogram, its most frequent rows) reads the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenmill.functions.bytelevel import byte_symbols, to_byte_symbols
from tokenmill.functions.words import basic_tokens
from tokenmill.operators.dictionary import forms_of_counts, frequency_bins, prefixed_counts, word_counts
from tokenmill.operators.wordpiece import CONTINUATION
from tokenmill.scratch import stored

SPECIAL_TOKENS = ("[UNK]", "[CLS]", "[SEP]")


def substring_counts(counts: DataFrame, form, sizes=(2, 3, 4)) -> DataFrame:
    """``(piece, n_occ)`` of the substrings of distinct words, weighted by how
    often the words occur."""
    pieces = counts.withColumn("form", form).withColumn(
        "size", F.explode(F.array(*[F.lit(s) for s in sizes]))
    )
    # a word shorter than the size gives no start
    starts = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length("form") - F.col("size") + 1, F.lit(1))),
        lambda s: F.length("form") >= F.col("size"),
    )
    return (
        pieces.withColumn("start", F.explode(starts))
        .select(F.substring("form", F.col("start"), F.col("size")).alias("piece"), "n_occ")
        .groupBy("piece")
        .agg(F.sum("n_occ").alias("n_occ"))
    )


def most_frequent(counts: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent rows, equal counts by ``key``.

    Rows that are too rare to be among them are left out before the ordering,
    by a histogram of two leading digits.
    """
    least = least_frequency(counts, n)
    return counts.filter(F.col("n_occ") >= least).orderBy(F.desc("n_occ"), key).limit(n)


def least_frequency(counts: DataFrame, n: int) -> int:
    """A frequency that at least ``n`` rows reach, if there are as many."""
    rows = frequency_bins(counts).collect()
    held = 0
    for row in sorted(rows, key=lambda r: -r["least"]):
        held += row["rows"]
        if held >= n:
            return row["least"]
    return 0


def numbered(tokens: DataFrame, first_id: int) -> DataFrame:
    """IDs by falling frequency; the input is a bounded list of tokens."""
    order = W.orderBy(F.desc("n_occ"), "token")
    return tokens.select(
        "token", (F.row_number().over(order) + (first_id - 1)).cast("int").alias("token_id")
    )


def byte_tokens(spark) -> DataFrame:
    rows = list(zip(byte_symbols(), range(256)))
    return spark.createDataFrame(rows, "token string, token_id int")


def byte_level_vocabulary(
    words: DataFrame, n_words: int = 30_000, n_pieces: int = 20_001
) -> DataFrame:
    """``(token, token_id)``: the byte alphabet, then the most frequent word
    forms and the most frequent short substrings. The defaults give at most the
    published 50,257 tokens; a corpus that has fewer gives what it has."""
    counts = stored(prefixed_counts(words), "corpus-words")
    forms = most_frequent(forms_of_counts(counts), "form", n_words)
    each = counts.groupBy("word").agg(F.sum("n_occ").alias("n_occ"))
    pieces = most_frequent(
        stored(substring_counts(each, to_byte_symbols(F.col("word"))), "corpus-pieces"), "piece", n_pieces
    )
    tokens = (
        forms.select(F.col("form").alias("token"), "n_occ")
        .union(pieces.select(F.col("piece").alias("token"), "n_occ"))
        .groupBy("token")
        .agg(F.max("n_occ").alias("n_occ"))
        .filter(~F.col("token").isin(byte_symbols()))
    )
    return byte_tokens(words.sparkSession).union(numbered(tokens, 256))


def wordpiece_vocabulary(
    chunks: DataFrame, n_words: int = 15_000, n_pieces: int = 15_519
) -> DataFrame:
    """``(token, token_id)``: the special tokens, then the most frequent basic
    tokens and the most frequent beginnings and continuations of one to four
    characters; at most the published 30,522 by default."""
    basic = (
        word_counts(chunks)
        .select(F.explode(basic_tokens(F.col("word"))).alias("form"), "n_occ")
        .groupBy("form")
        .agg(F.sum("n_occ").alias("n_occ"))
    )
    basic = stored(basic, "corpus-basic")
    starts = basic.withColumn(
        "start", F.explode(F.sequence(F.lit(1), F.length("form")))
    ).withColumn("size", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])))
    piece = F.substring("form", F.col("start"), F.col("size"))
    pieces = (
        starts.filter(F.col("start") + F.col("size") <= F.length("form") + 1)
        .select(
            F.when(F.col("start") > 1, F.concat(F.lit(CONTINUATION), piece))
            .otherwise(piece)
            .alias("piece"),
            "n_occ",
        )
        .groupBy("piece")
        .agg(F.sum("n_occ").alias("n_occ"))
    )
    tokens = (
        most_frequent(basic, "form", n_words)
        .select(F.col("form").alias("token"), "n_occ")
        .union(
            most_frequent(stored(pieces, "corpus-pieces"), "piece", n_pieces).select(
                F.col("piece").alias("token"), "n_occ"
            )
        )
        .groupBy("token")
        .agg(F.max("n_occ").alias("n_occ"))
    )
    special = chunks.sparkSession.createDataFrame(
        [(t, i) for i, t in enumerate(SPECIAL_TOKENS)], "token string, token_id int"
    )
    return special.union(numbered(tokens, len(SPECIAL_TOKENS)))


def substring_merges(pre_tokens: DataFrame, n_rules: int = 49_992) -> DataFrame:
    """``(left, right, rank)``: the most frequent substrings of two to four
    symbols, short ones first; three symbols join a pair and a symbol, four
    symbols join two pairs."""
    counts = substring_counts(word_counts(pre_tokens), to_byte_symbols(F.col("word")))
    top = most_frequent(stored(counts, "corpus-pieces"), "piece", n_rules)
    cut = F.when(F.length("piece") == 2, 1).otherwise(2)
    order = W.orderBy(F.length("piece"), F.desc("n_occ"), "piece")
    return top.select(
        F.substring("piece", F.lit(1), cut).alias("left"),
        F.substring("piece", cut + 1, F.length("piece")).alias("right"),
        (F.row_number().over(order) - 1).alias("rank"),
    )


def merge_vocabulary(merges: DataFrame) -> DataFrame:
    """``(token, token_id)``: the byte alphabet, then one token per rule."""
    made = merges.select(
        F.concat("left", "right").alias("token"), (F.col("rank") + 256).alias("token_id")
    )
    return byte_tokens(merges.sparkSession).union(made)
