"""WordPiece over a table of texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokenmill.functions.words import basic_tokens, split_chunks, text_basic_tokens
from tokenmill.operators.assemble import assemble, bounds
from tokenmill.operators.dictionary import Dictionary, store_dictionary, word_counts
from tokenmill.operators.greedy import with_token_ids
from tokenmill.operators.inplace import PieceCut, encode_in_place
from tokenmill.operators.trie import Trie, lists
from tokenmill.operators.vocabulary import Vocabulary

# Mark of a continuation piece and longest word that the published
# rule cuts.
CONTINUATION = "##"
MAX_WORD_CHARS = 100


def special_id(vocab: Vocabulary, token: str) -> int:
    row = vocab.tokens.filter(F.col("token") == token).first()
    if row is None:
        raise ValueError(f"the vocabulary has no {token}")
    return row.token_id


class PieceCutter:
    """WordPiece of columns of basic tokens: one trie for beginnings, one for
    continuations without their mark."""

    def __init__(self, tokens: dict[str, int], unknown: int, max_word_chars: int | None) -> None:
        marked = {t: i for t, i in tokens.items() if t.startswith(CONTINUATION)}
        # a marked token may also begin a word that starts with the mark
        self.first = Trie((t.encode(), i) for t, i in tokens.items() if t)
        self.later = Trie((t[len(CONTINUATION) :].encode(), i) for t, i in marked.items() if t != CONTINUATION)
        self.unknown, self.max_word_chars = unknown, max_word_chars

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """IDs of all words, one after the other, and their numbers. The longest
        pieces follow one another from the start; a word that they do not cover
        is one unknown token."""
        sizes = pc.binary_length(words).to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), dtype=np.uint8)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        fits = sizes > 0
        if self.max_word_chars is not None:
            fits &= pc.utf8_length(words).to_numpy() <= self.max_word_chars
        stop = np.repeat(np.where(fits, ends, 0), sizes)
        begin = np.zeros(len(data), dtype=np.int64)
        begin[starts[fits]] = ends[fits]
        size, token = self.later.longest(data, stop)
        size_first, token_first = self.first.longest(data, begin)
        size[starts[fits]], token[starts[fits]] = size_first[starts[fits]], token_first[starts[fits]]
        whole = np.zeros(len(sizes), dtype=bool)
        visited = np.zeros(len(data), dtype=bool)
        word, at = np.flatnonzero(fits), starts[fits]
        while len(word):
            visited[at] = True
            step = size[at]
            word, at = word[step > 0], (at + step)[step > 0]
            over = at == ends[word]
            whole[word[over]] = True
            word, at = word[~over], at[~over]
        visited &= np.repeat(whole, sizes)
        visited[starts[~whole & (sizes > 0)]] = True
        token[starts[~whole & (sizes > 0)]] = self.unknown
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return token[visited], np.bincount(owner[visited], minlength=len(sizes))


@lru_cache(maxsize=8)
def piece_cutter(vocab: Vocabulary, unk: str, max_word_chars: int | None) -> PieceCutter:
    """Built once for a vocabulary, whatever the number of jobs that use it."""
    return PieceCutter(vocab.mapping, special_id(vocab, unk), max_word_chars)


def piece_words(
    words: DataFrame,
    vocab: Vocabulary,
    unk: str = "[UNK]",
    max_word_chars: int | None = MAX_WORD_CHARS,
) -> DataFrame:
    """``pieces`` of distinct ``word`` rows (chunks between white space): one
    array of token IDs per basic token, found where the words are. Basic tokens
    of more than ``max_word_chars`` characters are unknown; None sets no limit."""
    cutter = piece_cutter(vocab, unk, max_word_chars)
    names = [*words.columns, "pieces"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            basic = batch.column(batch.num_columns - 1)
            inner = lists(*cutter(basic.flatten()))
            counts = pc.list_value_length(basic).fill_null(0).to_numpy()
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            pieces = pa.ListArray.from_arrays(pa.array(offsets), inner)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pieces], names=names)

    fields = StructType.fromDDL("pieces array<array<int>>").fields
    rows = words.withColumn("_basic", basic_tokens(F.col("word")))
    return rows.mapInArrow(run, StructType([*words.schema.fields, *fields]))


def piece_dictionary(
    words: DataFrame, vocab: Vocabulary, max_word_chars: int | None = MAX_WORD_CHARS
) -> Dictionary:
    table = piece_words(word_counts(words), vocab, max_word_chars=max_word_chars)
    ids = F.flatten("pieces")
    size = F.octet_length("word") + 8 * F.size("pieces") + 4 * F.size(ids) + 32
    return store_dictionary(table, size, "piece-words")


def wordpiece_encode(
    texts: DataFrame,
    vocab: Vocabulary,
    keys: Sequence[str] = ("doc_id",),
    dictionary: Dictionary | None = None,
    max_words: int | None = None,
    max_tokens: int | None = None,
    special_tokens: bool = False,
    max_word_chars: int | None = MAX_WORD_CHARS,
    hot_rows: int | None = None,
    hot_bytes: int | None = None,
) -> DataFrame:
    """WordPiece of every text: ``token_ids`` and ``n_tokens``.

    ``max_words`` keeps the first words of a text, ``max_tokens`` the first
    tokens; ``special_tokens`` puts ``[CLS]`` and ``[SEP]`` around them. Words are
    cut where their text is, unless a dictionary or bounds are given.
    """
    if dictionary is None and hot_rows is None and hot_bytes is None:
        cut = PieceCut(piece_cutter(vocab, "[UNK]", max_word_chars))
        words = text_basic_tokens("text")
        if max_words is not None:
            words = F.slice(words, 1, max_words)
        rows = encode_in_place(texts, words, lambda: cut)
        ids = F.col("token_ids")
    else:
        if dictionary is None:
            dictionary = piece_dictionary(split_chunks(texts.select("text")), vocab, max_word_chars)
        rows = assemble(
            texts, keys, split_chunks, dictionary, F.col("pieces"), *bounds(hot_rows, hot_bytes)
        )
        words = F.flatten(F.transform("entries", lambda e: e["entry"]))
        if max_words is not None:
            words = F.slice(words, 1, max_words)
        ids = F.flatten(words)
    if not special_tokens:
        return with_token_ids(rows, ids, max_tokens)
    if max_tokens is not None:
        ids = F.slice(ids, 1, max(max_tokens - 2, 0))
    first, last = special_id(vocab, "[CLS]"), special_id(vocab, "[SEP]")
    return with_token_ids(rows, F.concat(F.array(F.lit(first)), ids, F.array(F.lit(last))), None)
