"""Greedy longest-match byte-level BPE over a table of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.words import spaced_words, split_words
from tokenmill.operators.assemble import assemble, bounds
from tokenmill.operators.dictionary import Dictionary, greedy_dictionary, vocabulary_segmenter
from tokenmill.operators.inplace import GreedyCut, encode_in_place
from tokenmill.operators.vocabulary import Vocabulary


def greedy_encode(
    texts: DataFrame,
    vocab: Vocabulary,
    keys: Sequence[str] = ("doc_id",),
    dictionary: Dictionary | None = None,
    byte_view: bool = False,
    max_tokens: int | None = None,
    max_word_bytes: int | None = None,
    max_match_bytes: int | None = None,
    hot_rows: int | None = None,
    hot_bytes: int | None = None,
) -> DataFrame:
    """``token_ids`` and ``n_tokens`` in place of ``text``, one row per text.

    ``keys`` identify a text and are unique; other columns are kept. A space
    before a word counts only after the first token of the text. With
    ``byte_view`` the texts hold one character per byte. Words are cut where their
    text is. ``dictionary`` may be one built earlier from a corpus that has all
    words of these texts: it is joined instead, as is one built here if bounds of
    its broadcast part are given.
    """
    if dictionary is None and hot_rows is None and hot_bytes is None:
        segmenter = vocabulary_segmenter(vocab, max_match_bytes)
        cut = GreedyCut(segmenter, byte_view, max_word_bytes)
        rows = encode_in_place(texts, spaced_words("text"), lambda: cut)
        return with_token_ids(rows, F.col("token_ids"), max_tokens)
    if dictionary is None:
        dictionary = greedy_dictionary(
            split_words(texts.select("text")), vocab, byte_view, max_word_bytes, max_match_bytes
        )
    later = F.when(F.col("has_space"), F.col("spaced")).otherwise(F.col("bare"))
    if vocab.covers_all_bytes:
        # every word gives a token, so the first word is the first to emit
        entry = F.when(F.col("word_idx") == 0, F.col("bare")).otherwise(later)
    else:
        entry = F.struct("bare", later.alias("later"))
    rows = assemble(
        texts, keys, split_words, dictionary, entry, *bounds(hot_rows, hot_bytes)
    )
    if vocab.covers_all_bytes:
        parts = F.transform("entries", lambda e: e["entry"])
    else:
        emitting = F.filter("entries", lambda e: F.size(e["entry"]["bare"]) > 0)
        # the first emitting word is a variable of the outer lambda: found once
        # for a text, not once for each of its words
        first = F.array(F.get(emitting, F.lit(0))["word_idx"])
        by_first = F.transform(
            first,
            lambda at: F.transform(
                "entries",
                lambda e: F.when(e["word_idx"] > at, e["entry"]["later"]).otherwise(
                    e["entry"]["bare"]
                ),
            ),
        )
        parts = F.get(by_first, F.lit(0))
    return with_token_ids(rows, F.flatten(parts), max_tokens)


def with_token_ids(rows: DataFrame, token_ids, max_tokens: int | None) -> DataFrame:
    kept = [c for c in rows.columns if c not in ("entries", "token_ids") and not c.startswith("_")]
    if max_tokens is not None:
        token_ids = F.slice(token_ids, 1, max_tokens)
    return rows.select(*kept, token_ids.alias("token_ids")).withColumn(
        "n_tokens", F.size("token_ids")
    )


def token_positions(encoded: DataFrame) -> DataFrame:
    """One row per token with its position in the text."""
    others = [c for c in encoded.columns if c not in ("token_ids", "n_tokens")]
    return encoded.select(*others, F.posexplode("token_ids").alias("pos", "token_id"))


def truncate_tokens(encoded: DataFrame, max_tokens: int) -> DataFrame:
    """The first ``max_tokens`` tokens of every text."""
    return encoded.withColumn("token_ids", F.slice("token_ids", 1, max_tokens)).withColumn(
        "n_tokens", F.size("token_ids")
    )
