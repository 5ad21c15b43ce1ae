"""Vocabulary and merge files.

These files are small (tens of thousands of lines) and their line order carries
meaning, so each is read whole and exploded with its positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _lines() -> Column:
    return F.split("value", "\r\n|\n|\r")


def load_bpe_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(token, token_id)`` of a JSON object; of equal keys the last counts."""
    entries = F.map_entries(F.from_json("value", "map<string,int>"))
    return (
        _whole(spark, path)
        .select(F.posexplode(entries).alias("_at", "_entry"))
        .groupBy(F.col("_entry.key").alias("token"))
        .agg(F.max_by("_entry.value", "_at").alias("token_id"))
    )


def load_merges(spark: SparkSession, path: str) -> DataFrame:
    """``(left, right, rank)``; only a first line that names the version is a
    header, other lines that begin with ``#`` are rules."""
    rules = F.filter(
        _lines(), lambda line, at: (line != "") & ~((at == 0) & line.startswith("#version"))
    )
    pair = F.split("_line", " ", 2)
    return (
        _whole(spark, path)
        .select(F.posexplode(rules).alias("rank", "_line"))
        .select(pair[0].alias("left"), pair[1].alias("right"), "rank")
    )


def load_wordpiece_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(token, token_id)``: IDs follow line order after blank lines are
    dropped."""
    trimmed = F.transform(
        _lines(), lambda line: F.regexp_replace(line, "(?U)^\\s+|\\s+$", "")
    )
    return (
        _whole(spark, path)
        .select(F.posexplode(F.filter(trimmed, lambda t: t != "")).alias("token_id", "token"))
        .select("token", "token_id")
    )
