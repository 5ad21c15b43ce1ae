"""Texts cut into tokens where they are.

A batch of texts comes with its units (words, pre-tokens, basic tokens) as lists.
The different units of the batch are cut once and gathered back in order, so no
row leaves its task: nothing is shuffled or stored, and the work is in proportion
to the input, however many different words a corpus has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokenmill.functions.bytelevel import byte_symbols
from tokenmill.operators.trie import lists

#: Units that are worked on together; a text with more is worked on alone.
UNITS = 1 << 20

_POINTS = np.array([ord(s) for s in byte_symbols()], dtype=np.uint16)


def forms_of(words: Sequence[str], byte_view: bool = False) -> list[str]:
    """Words in the byte alphabet; those of a byte view have no line feed."""
    if not words:
        return []
    # UTF-8 has no byte 255, and no symbol is a line feed
    mark = b"\n" if byte_view else b"\xff"
    data = np.frombuffer(mark.join(w.encode("latin-1" if byte_view else "utf-8") for w in words), np.uint8)
    points = _POINTS[data]
    points[data == mark[0]] = ord("\n")
    return points.astype("<u2").tobytes().decode("utf-16-le").split("\n")


def distinct(units: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different units of lists, which of them each unit is, and the offsets
    of the lists; a list that is null has none."""
    counts = pc.list_value_length(units).fill_null(0).to_numpy()
    coded = units.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def gathered(entries: pa.ListArray, which: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """For each list of units what its entries hold, one after the other."""
    sizes = pc.list_value_length(entries).to_numpy()[which]
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends[offsets].astype(np.int32)), entries.take(pa.array(which)).flatten())


def parts(batch: pa.RecordBatch, limit: int = UNITS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` units of its last column."""
    ends = np.cumsum(pc.list_value_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(), dtype=np.int64)
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def encode_in_place(
    texts: DataFrame, units: Column, cutter: Callable[[], Callable[[pa.ListArray], pa.ListArray]]
) -> DataFrame:
    """``token_ids`` in place of ``text``. Each task asks ``cutter`` for a function
    from lists of units to lists of IDs."""
    kept = [c for c in texts.columns if c != "text"]
    rows = texts.select(*kept, units.alias("_units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter()
        for batch in batches:
            for part in parts(batch):
                ids = cut(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*kept, "token_ids"])

    fields = StructType.fromDDL("token_ids array<int>").fields
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *fields]))


class GreedyCut:
    """Greedy tokens of lists of words with the space before them, if any. A space
    counts only after the first word of a text that gives a token."""

    def __init__(self, segmenter, byte_view: bool = False, max_word_bytes: int | None = None) -> None:
        self.segmenter, self.byte_view, self.max_word_bytes = segmenter, byte_view, max_word_bytes

    def __call__(self, units: pa.ListArray) -> pa.ListArray:
        names, which, offsets = distinct(units)
        words = names.to_pylist()
        has_space = np.fromiter((w.startswith(" ") for w in words), bool, len(words))
        forms = forms_of([w[1:] if s else w for w, s in zip(words, has_space.tolist())], self.byte_view)
        if self.max_word_bytes is not None:
            forms = [f[: self.max_word_bytes] for f in forms]
        bare, spaced = self.segmenter(pa.array(forms, pa.string()))
        emitting = np.flatnonzero(pc.list_value_length(bare).to_numpy()[which] > 0)
        # the first emitting unit of every text, or a later text's: then it has none
        first = np.append(emitting, len(which))[np.searchsorted(emitting, offsets[:-1])]
        later = np.arange(len(which)) > np.repeat(first, np.diff(offsets))
        return gathered(
            pa.concat_arrays([bare, spaced]), which + len(names) * (has_space[which] & later), offsets
        )


class MergeCut:
    """Merge-rank tokens of lists of pre-tokens. A task keeps the tokens of the
    pre-tokens it has met, at most ``limit`` of them."""

    def __init__(self, merge: Callable[[str], list[int]], limit: int = 200_000) -> None:
        self.merge, self.limit, self.known = merge, limit, {}

    def __call__(self, units: pa.ListArray) -> pa.ListArray:
        names, which, offsets = distinct(units)
        if len(self.known) > self.limit:
            self.known.clear()
        words = names.to_pylist()
        found = []
        for word, form in zip(words, forms_of(words)):
            ids = self.known.get(word)
            if ids is None:
                ids = self.merge(form)
                if len(word) <= 64 and len(self.known) <= self.limit:
                    self.known[word] = ids
            found.append(ids)
        return gathered(pa.array(found, pa.list_(pa.int32())), which, offsets)


class PieceCut:
    """WordPiece of lists of basic tokens."""

    def __init__(self, cutter: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> None:
        self.cutter = cutter

    def __call__(self, units: pa.ListArray) -> pa.ListArray:
        names, which, offsets = distinct(units)
        return gathered(lists(*self.cutter(names)), which, offsets)
