"""Synthetic texts, the same for a seed however the rows are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def pattern_text(n_chars: Column) -> Column:
    """Letter ``i % 26`` at place i, a space at every fifth place."""
    # the pattern repeats after 26 * 5 places
    period = "".join(" " if i % 5 == 4 else LETTERS[i % 26] for i in range(130))
    times = F.ceil(n_chars / 130).cast("int")
    return F.substring(F.repeat(F.lit(period), times), F.lit(1), n_chars.cast("int"))


def _hex_letter(digest: Column, place: Column) -> Column:
    pair = F.conv(F.substring(digest, place * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.substring(F.lit(LETTERS), pair % 26 + 1, F.lit(1))


def random_text(row_key: Column, n_chars: Column, seed: int) -> Column:
    """Random letters with a space at every fifth place.

    Sixteen letters come from one digest of (seed, row key, block number).
    """

    def block(number: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), row_key.cast("string"), number.cast("string")).cast("binary"))
        letters = F.transform(
            F.sequence(F.lit(0), F.lit(15)),
            lambda i: F.when((number * 16 + i) % 5 == 4, " ").otherwise(_hex_letter(digest, i)),
        )
        return F.array_join(letters, "")

    blocks = F.sequence(F.lit(0), F.ceil(n_chars / 16).cast("int"))
    return F.substring(
        F.array_join(F.transform(blocks, block), ""), F.lit(1), n_chars.cast("int")
    )


def random_words_text(row_key: Column, n_chars: Column, seed: int) -> Column:
    """Random words of four to eight letters joined by spaces, cut to size.

    A cut just after a word leaves no space at the end.
    """

    def word(number: Column) -> Column:
        digest = F.md5(F.concat_ws("/", F.lit(str(seed)), row_key.cast("string"), number.cast("string")).cast("binary"))
        size = F.conv(F.substring(digest, F.lit(31), F.lit(2)), 16, 10).cast("int") % 5 + 4
        letters = F.transform(
            F.sequence(F.lit(0), size - 1), lambda i: _hex_letter(digest, i)
        )
        return F.array_join(letters, "")

    numbers = F.sequence(F.lit(0), F.ceil(n_chars / 5).cast("int"))
    joined = F.array_join(F.transform(numbers, word), " ")
    return F.rtrim(F.substring(joined, F.lit(1), n_chars.cast("int")))


def generate_texts(
    spark: SparkSession, n_rows: int, payload_kb: int, kind: str = "words", seed: int = 42
) -> DataFrame:
    """``n_rows`` synthetic texts of ``payload_kb`` KB: ``pattern``, ``letters``
    or ``words``."""
    rows = spark.range(n_rows).withColumnRenamed("id", "doc_id")
    size = F.lit(payload_kb * 1024)
    text = {
        "pattern": lambda: pattern_text(size),
        "letters": lambda: random_text(F.col("doc_id"), size, seed),
        "words": lambda: random_words_text(F.col("doc_id"), size, seed),
    }[kind]()
    return rows.withColumn("text", text)
