"""Tokens per text by four tokenizers, counted in one pass over the texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokenmill.functions.words import chunk_list, pre_token_list, spaced_words, text_basic_tokens
from tokenmill.operators.assemble import HOT_BYTES, HOT_ROWS
from tokenmill.operators.dictionary import (
    Dictionary,
    hot_words,
    segment_words,
    store_dictionary,
    vocabulary_segmenter,
    word_counts,
)
from tokenmill.operators.inplace import GreedyCut, MergeCut, PieceCut, parts
from tokenmill.operators.merges import MergeRules, id_merger, merge_words
from tokenmill.operators.vocabulary import Vocabulary
from tokenmill.operators.wordpiece import MAX_WORD_CHARS, piece_cutter, piece_words

#: The units of the tokenizers, told apart by a first letter.
GREEDY, MERGE, PIECE = "g", "m", "p"
ALGORITHMS = ("greedy", "merge_bpe", "wordpiece")


def text_units(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``word`` (letter and unit) and ``spaced`` of all units of a text, words,
    pre-tokens and chunks; a text without any keeps one row without a word.

    A space before a word counts from the second word on.
    """

    def marked(letter: str, units: Column) -> Column:
        return F.transform(
            units, lambda u: F.struct(F.concat(F.lit(letter), u).alias("word"), F.lit(False).alias("spaced"))
        )

    words = F.transform(
        spaced_words("text"),
        lambda w, i: F.struct(
            F.concat(F.lit(GREEDY), F.ltrim(w)).alias("word"), (w.startswith(" ") & (i > 0)).alias("spaced")
        ),
    )
    units = F.concat(words, marked(MERGE, pre_token_list("text")), marked(PIECE, chunk_list("text")))
    return texts.select(*keys, F.explode_outer(units).alias("_unit")).select(*keys, "_unit.*")


def unit_dictionary(
    texts: DataFrame, vocab: Vocabulary, merges: MergeRules, merge_vocab: Vocabulary, pieces: Vocabulary
) -> Dictionary:
    """Numbers of tokens of all different units: ``n`` and, with a space before
    the unit, ``n_spaced``. The texts are split and counted once."""
    counts = word_counts(text_units(texts.select("text"), []))
    letter, unit = F.substring("word", 1, 1), F.expr("substring(word, 2)")
    counts = store_dictionary(counts, F.lit(0), "units").table
    found = []
    for kind, cut, n, spaced in (
        (GREEDY, lambda w: segment_words(w, vocab), F.size("bare"), F.size("spaced")),
        (MERGE, lambda w: merge_words(w, merges, merge_vocab), F.size("ids"), F.size("ids")),
        (PIECE, lambda w: piece_words(w, pieces), F.size(F.flatten("pieces")), F.size(F.flatten("pieces"))),
    ):
        mine = counts.where(letter == kind).select(unit.alias("word"), "n_occ")
        found.append(
            cut(mine).select(F.concat(F.lit(kind), "word").alias("word"), "n_occ", n.alias("n"), spaced.alias("n_spaced"))
        )
    table = found[0].unionByName(found[1]).unionByName(found[2])
    return store_dictionary(table, F.octet_length("word") + 24, "unit-tokens")


def _hashed(modulus_bytes: int) -> Column:
    n = F.coalesce(F.octet_length("text"), F.lit(0))
    return F.floor(n / modulus_bytes).cast("long").alias("hash")


def counted_in_place(
    texts: DataFrame,
    vocab: Vocabulary,
    merges: MergeRules,
    merge_vocab: Vocabulary,
    pieces: Vocabulary,
    keys: Sequence[str] = ("doc_id",),
    modulus_bytes: int = 4,
) -> DataFrame:
    """The columns of :func:`compare_counts`; each text is cut by all tokenizers
    where it is, in one pass without a shuffle."""
    units = {"_words": spaced_words("text"), "_basic": text_basic_tokens("text"), "_pre": pre_token_list("text")}
    rows = texts.select(*keys, _hashed(modulus_bytes), *[column.alias(name) for name, column in units.items()])
    greedy = GreedyCut(vocabulary_segmenter(vocab, None))
    merge = id_merger(merges, merge_vocab)
    piece = PieceCut(piece_cutter(pieces, "[UNK]", MAX_WORD_CHARS))
    names = [*keys, *ALGORITHMS, "hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutters = {"_words": greedy, "_pre": MergeCut(merge), "_basic": piece}
        for batch in batches:
            for part in parts(batch):
                n = [pc.list_value_length(cut(part.column(c))).cast(pa.int64()) for c, cut in cutters.items()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *n, part.column("hash")], names=names)

    counts = StructType.fromDDL(", ".join(f"{a} long" for a in [*ALGORITHMS, "hash"])).fields
    return rows.mapInArrow(run, StructType([*(rows.schema[k] for k in keys), *counts]))


def compare_counts(
    texts: DataFrame,
    dictionary: Dictionary,
    modulus_bytes: int = 4,
    keys: Sequence[str] = ("doc_id",),
    hot_rows: int = HOT_ROWS,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """Tokens per text, one column per algorithm; ``hash`` has one for each
    ``modulus_bytes`` bytes.

    Sums need no order, so units are joined where their text is, the numbers of
    a text are added up before the shuffle, and a dictionary beyond the bounds
    is sent in its most frequent part only; the rest is joined by a shuffle.
    """
    whole = dictionary.n_words <= hot_rows and dictionary.n_bytes <= hot_bytes
    hot = dictionary.table if whole else hot_words(dictionary, hot_rows, hot_bytes)
    hot = F.broadcast(hot.select("word", "n", "n_spaced"))
    n = F.when(F.col("spaced"), F.col("n_spaced")).otherwise(F.col("n"))
    sums = [
        F.coalesce(F.sum(F.when(F.substring("word", 1, 1) == kind, n)), F.lit(0)).cast("long").alias(name)
        for kind, name in zip((GREEDY, MERGE, PIECE), ALGORITHMS)
    ]
    units = text_units(texts.select(*keys, _hashed(modulus_bytes), "text"), [*keys, "hash"])
    near = units.join(hot, "word", "left").groupBy(*keys, "hash").agg(*sums)
    if whole:
        return near.select(*keys, *ALGORITHMS, "hash")
    rare = units.join(hot.select("word"), "word", "left_anti")
    cold = dictionary.table.select("word", "n", "n_spaced").join(hot.select("word"), "word", "left_anti")
    far = rare.join(cold, "word").groupBy(*keys, "hash").agg(*sums)
    both = near.unionByName(far).groupBy(*keys).agg(*[F.sum(a).alias(a) for a in ALGORITHMS], F.max("hash").alias("hash"))
    return both.select(*keys, *ALGORITHMS, "hash")


def compare_tokenizers(
    texts: DataFrame,
    vocab: Vocabulary,
    merges: MergeRules,
    merge_vocab: Vocabulary,
    pieces: Vocabulary,
    keys: Sequence[str] = ("doc_id",),
    **bounds: int,
) -> DataFrame:
    """Tokens per text of the greedy, merge-rank and WordPiece tokenizers and of
    the hash; ``keys`` identify a text. The greedy vocabulary has all bytes, so
    that each word gives a token. With bounds of its broadcast part a dictionary
    of all units is made and joined instead of cutting the texts where they are."""
    if not vocab.covers_all_bytes:
        raise ValueError("the vocabulary lacks some of the 256 bytes")
    if not bounds:
        return counted_in_place(texts, vocab, merges, merge_vocab, pieces, keys)
    dictionary = unit_dictionary(texts, vocab, merges, merge_vocab, pieces)
    return compare_counts(texts, dictionary, keys=keys, **bounds)
