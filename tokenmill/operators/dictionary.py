"""Distinct-word dictionaries: each different word is looked up and cut into
tokens once, however often the corpus uses it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokenmill.functions.bytelevel import (
    SPACE_SYMBOL,
    byte_symbols,
    symbols_of_byte_view,
    to_byte_symbols,
)
from tokenmill.operators.trie import Trie, bytes_of_forms, lists
from tokenmill.operators.vocabulary import Vocabulary
from tokenmill.scratch import stored


def word_counts(words: DataFrame) -> DataFrame:
    """``(word, n_occ)``; partial counts are combined before the shuffle, so a
    hot word costs one row per map task."""
    return (
        words.filter(F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_occ"))
    )


def prefixed_counts(words: DataFrame) -> DataFrame:
    """``(word, prefixed, n_occ)``: prefixed is every word but the first of its
    text that has a space before it."""
    prefixed = F.col("has_space") & (F.col("word_idx") > 0)
    return (
        words.filter(F.col("word").isNotNull())
        .groupBy("word", prefixed.alias("prefixed"))
        .agg(F.count(F.lit(1)).alias("n_occ"))
    )


def forms_of_counts(counts: DataFrame) -> DataFrame:
    """``(form, n_occ)`` of :func:`prefixed_counts`."""
    form = F.concat(
        F.when(F.col("prefixed"), SPACE_SYMBOL).otherwise(""), to_byte_symbols(F.col("word"))
    )
    return counts.select(form.alias("form"), "n_occ")


def word_forms(words: DataFrame) -> DataFrame:
    """``(form, n_occ)``: words in the byte alphabet, with the space symbol on
    every word but the first of its text that has a space before it."""
    return forms_of_counts(prefixed_counts(words))


def whole_word_hits(forms: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Forms that are a vocabulary token."""
    tokens = vocab.lookup().withColumnRenamed("token", "form")
    return forms.join(tokens, "form", "inner")


def whole_word_misses(forms: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Forms that have to be cut into tokens."""
    return forms.join(vocab.lookup().withColumnRenamed("token", "form"), "form", "left_anti")


class Segmenter:
    """Greedy tokens of columns of forms: tries and token IDs of a vocabulary.

    Without limits one trie serves; with ``max_match_bytes`` tokens longer than
    that in the byte alphabet are matched as whole words only.
    """

    def __init__(self, tokens: dict[str, int], max_match_bytes: int | None = None) -> None:
        fitting = tokens.items()
        if max_match_bytes is not None:
            fitting = [(t, i) for t, i in fitting if len(t.encode()) <= max_match_bytes]
        symbols = {s: b for b, s in enumerate(byte_symbols())}
        # a token with other symbols fits nowhere
        self.trie = Trie((bytes(symbols[s] for s in t), i) for t, i in fitting if t and set(t) <= symbols.keys())
        self.whole_first = max_match_bytes is not None
        self.names = pa.array(list(tokens), pa.string())
        self.ids = np.array([*tokens.values(), -1], dtype=np.int32)
        self.space = tokens.get(SPACE_SYMBOL)

    def whole(self, forms: pa.Array) -> np.ndarray:
        """Token IDs of whole forms, -1 where there is none."""
        found = pc.index_in(forms, self.names)
        return self.ids[found.fill_null(len(self.names)).to_numpy(zero_copy_only=False)]

    def __call__(self, forms: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
        """``bare`` and ``spaced`` of every form."""
        data, ends = bytes_of_forms(forms.to_pylist())
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
        ids, counts = self.trie.cut(data, starts, ends)
        bare = _replaced(ids, counts, self.whole(forms)) if self.whole_first else (ids, counts)
        prefixed = self.whole(pc.binary_join_element_wise(pa.scalar(SPACE_SYMBOL), forms, ""))
        spaced, n_spaced = ids, counts
        if self.space is not None:
            firsts = np.cumsum(counts) - counts
            spaced, n_spaced = np.insert(ids, firsts, np.int32(self.space)), counts + 1
        spaced, n_spaced = _replaced(spaced, n_spaced, prefixed)
        return lists(*bare), lists(spaced, n_spaced)


def _replaced(ids: np.ndarray, counts: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of IDs with those of words that are a token taken by it."""
    found = whole >= 0
    kept = ids[~np.repeat(found, counts)]
    counts = np.where(found, 1, counts)
    firsts = np.cumsum(counts) - counts
    out = np.empty(counts.sum(), dtype=np.int32)
    taken = np.zeros(len(out), dtype=bool)
    taken[firsts[found]] = True
    out[taken], out[~taken] = whole[found], kept
    return out, counts


@lru_cache(maxsize=8)
def vocabulary_segmenter(vocab: Vocabulary, max_match_bytes: int | None) -> Segmenter:
    """Built once for a vocabulary, whatever the number of jobs that use it."""
    return Segmenter(vocab.mapping, max_match_bytes)


def segment_words(
    words: DataFrame,
    vocab: Vocabulary,
    byte_view: bool = False,
    max_word_bytes: int | None = None,
    max_match_bytes: int | None = None,
) -> DataFrame:
    """Greedy tokens of distinct ``word`` rows.

    Adds ``bare`` (token IDs of the word without a space before it) and
    ``spaced`` (with one): the prefixed whole word if it is a token, else the
    space symbol, when the vocabulary has it, and the bare tokens. Words are cut
    where they are, in columns of some thousands; nothing is shuffled.
    """
    symbols = symbols_of_byte_view if byte_view else to_byte_symbols
    form = symbols(F.col("word"))
    if max_word_bytes is not None:
        form = F.substring(form, F.lit(1), F.lit(max_word_bytes))
    segmenter = vocabulary_segmenter(vocab, max_match_bytes)
    rows = words.withColumn("_form", form)
    names = [*words.columns, "bare", "spaced"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = segmenter(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cut], names=names)

    schema = StructType([*words.schema.fields, *StructType.fromDDL("bare array<int>, spaced array<int>").fields])
    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Dictionary:
    """A stored table with one row per distinct ``word``, ``n_occ`` and the
    payload columns a tokenizer puts in place of the word."""

    table: DataFrame
    n_words: int
    n_bytes: int

    @property
    def payload(self) -> list[str]:
        return [c for c in self.table.columns if c not in ("word", "n_occ", "n_bytes")]


def store_dictionary(table: DataFrame, row_bytes: Column, name: str) -> Dictionary:
    """Materialise a dictionary: later jobs read it several times."""
    kept = stored(table.withColumn("n_bytes", row_bytes.cast("long")), name)
    n_words, n_bytes = kept.agg(F.count(F.lit(1)), F.sum("n_bytes")).first()
    return Dictionary(kept, n_words, n_bytes or 0)


def greedy_dictionary(
    words: DataFrame,
    vocab: Vocabulary,
    byte_view: bool = False,
    max_word_bytes: int | None = None,
    max_match_bytes: int | None = None,
) -> Dictionary:
    table = segment_words(
        word_counts(words), vocab, byte_view, max_word_bytes, max_match_bytes
    )
    size = F.octet_length("word") + 4 * F.size("bare") + 4 * F.size("spaced") + 32
    return store_dictionary(table, size, "greedy-words")


def frequency_bins(counts: DataFrame, *sums: Column) -> DataFrame:
    """Rows by the two leading digits of ``n_occ``: ``least`` and ``rows``, at
    most 90 for each power of ten, whatever the table's size."""
    digits = F.length(F.col("n_occ").cast("string"))
    scale = F.pow(F.lit(10.0), F.greatest(digits - 2, F.lit(0)))
    least = (F.floor(F.col("n_occ") / scale) * scale).cast("long")
    return counts.groupBy(least.alias("least")).agg(F.count(F.lit(1)).alias("rows"), *sums)


def hot_words(dictionary: Dictionary, max_rows: int, max_bytes: int) -> DataFrame:
    """All words that are used at least so often that their rows fit the bounds
    together.

    The frequency is read off a histogram, so no task sorts words.
    """
    bins = frequency_bins(dictionary.table, F.sum("n_bytes").alias("size")).collect()
    rows = size = 0
    least = None
    for one in sorted(bins, key=lambda r: -r["least"]):
        rows, size = rows + one["rows"], size + one["size"]
        if rows > max_rows or size > max_bytes:
            break
        least = one["least"]
    return dictionary.table.filter(F.lit(False) if least is None else F.col("n_occ") >= least)
