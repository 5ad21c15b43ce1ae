"""Merge-rank BPE: distinct pre-tokens are merged by rule rank."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokenmill.functions.bytelevel import to_byte_symbols
from tokenmill.functions.words import pre_token_list, split_pre_tokens
from tokenmill.operators.assemble import assemble, bounds
from tokenmill.operators.dictionary import Dictionary, store_dictionary, word_counts
from tokenmill.operators.greedy import with_token_ids
from tokenmill.operators.inplace import MergeCut, encode_in_place
from tokenmill.operators.trie import lists
from tokenmill.operators.vocabulary import Vocabulary
from tokenmill.sizes import BROADCAST_BYTES, BROADCAST_ROWS

#: Pairs that no rule joins.
NEVER = 1 << 62


@dataclass(frozen=True)
class MergeRules:
    """``rules(token, left_size, rank)`` and the rank of every pair that a rule
    joins. In learned order both parts of every rule are made by rules of lower
    rank; published files need not be."""

    rules: DataFrame
    ranks: dict[tuple[str, str], int]
    longest: int
    learned_order: bool


def merge_rules(merges: DataFrame) -> MergeRules:
    """Measure a ``(left, right, rank)`` table and take it in. Of equal rules
    the first counts. Beyond the broadcast bounds it is refused: every task
    holds the rules."""
    size = F.octet_length("left") + F.octet_length("right") + 8
    n_rules, n_bytes = merges.agg(F.count(F.lit(1)), F.sum(size)).first()
    if n_rules > BROADCAST_ROWS or (n_bytes or 0) > BROADCAST_BYTES:
        raise ValueError(f"{n_rules} rules of {n_bytes} bytes are too many to send")
    ranks: dict[tuple[str, str], int] = {}
    made: dict[str, int] = {}
    for r in merges.orderBy("rank").collect():
        ranks.setdefault((r.left, r.right), r.rank)
        made[r.left + r.right] = r.rank
    late = any(made.get(part, -1) >= rank for pair, rank in ranks.items() for part in pair)
    rules = merges.select(
        F.concat("left", "right").alias("token"), F.length("left").alias("left_size"), "rank"
    )
    return MergeRules(rules, ranks, max(map(len, made), default=1), not late)


def merged(form: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The pieces of a form: again and again the pair of lowest rank is joined,
    the leftmost of equal ones.

    Pieces are a linked list, and a queue gives the next pair; an entry whose
    pieces have changed since is passed over.
    """
    pieces: list[str | None] = list(form)
    n = len(pieces)
    if n < 2:
        return pieces
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [
        (rank, i, a, b)
        for i, (a, b) in enumerate(zip(form, form[1:]))
        if (rank := ranks.get((a, b), NEVER)) < NEVER
    ]
    heapq.heapify(queue)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i] if pieces[i] == a else n
        if j >= n or pieces[j] != b:
            continue
        pieces[i], pieces[j] = a + b, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get((a + b, pieces[k]), NEVER)) < NEVER:
                heapq.heappush(queue, (rank, i, a + b, pieces[k]))
        h = before[i]
        if h >= 0 and (rank := ranks.get((pieces[h], a + b), NEVER)) < NEVER:
            heapq.heappush(queue, (rank, h, pieces[h], a + b))
    return [p for p in pieces if p is not None]


def id_merger(merges: MergeRules, vocab: Vocabulary) -> Callable[[str], list[int]]:
    """IDs of a form; a piece without a token gives nothing."""
    ranks, tokens = merges.ranks, vocab.mapping
    return lambda form: [i for i in map(tokens.get, merged(form, ranks)) if i is not None]


def merge_words(words: DataFrame, merges: MergeRules, vocab: Vocabulary) -> DataFrame:
    """``ids`` of distinct ``word`` rows (pre-tokens), found where the words are.
    A piece without a token gives nothing."""
    merge = id_merger(merges, vocab)
    names = [*words.columns, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            counts = []
            for form in batch.column(batch.num_columns - 1).to_pylist():
                held = len(ids)
                ids += merge(form)
                counts.append(len(ids) - held)
            found = lists(np.array(ids, dtype=np.int32), np.array(counts, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=names)

    schema = StructType([*words.schema.fields, *StructType.fromDDL("ids array<int>").fields])
    return words.withColumn("_form", to_byte_symbols(F.col("word"))).mapInArrow(run, schema)


def merge_dictionary(words: DataFrame, merges: MergeRules, vocab: Vocabulary) -> Dictionary:
    table = merge_words(word_counts(words), merges, vocab)
    size = F.octet_length("word") + 4 * F.size("ids") + 32
    return store_dictionary(table, size, "merge-words")


def merge_encode(
    texts: DataFrame,
    merges: MergeRules,
    vocab: Vocabulary,
    keys: Sequence[str] = ("doc_id",),
    dictionary: Dictionary | None = None,
    max_tokens: int | None = None,
    hot_rows: int | None = None,
    hot_bytes: int | None = None,
) -> DataFrame:
    """Merge-rank BPE of every text: ``token_ids`` and ``n_tokens``. Pre-tokens are
    merged where their text is, unless a dictionary or bounds are given."""
    if dictionary is None and hot_rows is None and hot_bytes is None:
        merge = id_merger(merges, vocab)
        rows = encode_in_place(texts, pre_token_list("text"), lambda: MergeCut(merge))
        return with_token_ids(rows, F.col("token_ids"), max_tokens)
    if dictionary is None:
        dictionary = merge_dictionary(split_pre_tokens(texts.select("text")), merges, vocab)
    rows = assemble(
        texts, keys, split_pre_tokens, dictionary, F.col("ids"), *bounds(hot_rows, hot_bytes)
    )
    ids = F.flatten(F.transform("entries", lambda e: e["entry"]))
    return with_token_ids(rows, ids, max_tokens)
