"""Putting dictionary entries back in word order, one row per text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.operators.dictionary import Dictionary, hot_words
from tokenmill.sizes import BROADCAST_BYTES

HOT_ROWS = 500_000
HOT_BYTES = BROADCAST_BYTES


def bounds(hot_rows: int | None, hot_bytes: int | None) -> tuple[int, int]:
    """The bounds asked for, or the usual ones."""
    return HOT_ROWS if hot_rows is None else hot_rows, HOT_BYTES if hot_bytes is None else hot_bytes


def assemble(
    texts: DataFrame,
    keys: Sequence[str],
    split: Callable[[DataFrame], DataFrame],
    dictionary: Dictionary,
    entry: Column,
    hot_rows: int = HOT_ROWS,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """One row per text with ``entries``: an array of ``(word_idx, entry)`` in
    word order. ``keys`` identify a text; further columns are kept.

    Texts are placed by key once; words never leave the partition of their
    text unless they are missing from the hot part of the dictionary, which is
    broadcast. A dictionary in bounds is hot as a whole. Otherwise the
    most frequent words are, and only the others are shuffled: a word with a
    large share of all rows is always among the hot ones.
    """
    kept = [c for c in texts.columns if c != "text"]
    words = split(texts.repartition(*keys))
    payload = dictionary.payload
    item = F.struct("word_idx", entry.alias("entry"))
    if dictionary.n_words <= hot_rows and dictionary.n_bytes <= hot_bytes:
        hot = dictionary.table.select("word", *payload)
        joined = words.join(F.broadcast(hot), "word", "left")
        items = F.when(F.col("word").isNotNull(), item)
        return joined.groupBy(*kept).agg(
            F.sort_array(F.collect_list(items)).alias("entries")
        )

    hot = hot_words(dictionary, hot_rows, hot_bytes).select(
        "word", *payload, F.lit(True).alias("_hot")
    )
    joined = words.join(F.broadcast(hot), "word", "left")
    near = joined.groupBy(*kept).agg(
        F.collect_list(F.when(F.col("_hot"), item)).alias("_near")
    )
    cold = dictionary.table.select("word", *payload).join(
        F.broadcast(hot.select("word")), "word", "left_anti"
    )
    # rare words are shuffled by word anyway, so their texts need no placing
    rare = (
        split(texts)
        .filter(F.col("word").isNotNull())
        .join(F.broadcast(hot.select("word")), "word", "left_anti")
    )
    far = (
        rare.join(cold, "word")
        .groupBy(*keys)
        .agg(F.collect_list(item).alias("_far"))
    )
    both = F.concat("_near", F.coalesce("_far", F.slice("_near", 1, 0)))
    return near.join(far, list(keys), "left").select(
        *kept, F.sort_array(both).alias("entries")
    )
