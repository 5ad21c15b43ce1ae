"""Byte-level BPE as a monoid.

The elements are token sequences that are the encoding of their bytes, the unit
is the empty sequence, and the product of two sequences is the encoding of the
joined bytes. A text is cut into matches of the split pattern, which never merge
with each other: their product is plain concatenation. A match is halved until
the parts are short, the parts are encoded by merging the lowest rank first, and
neighbours are joined: only a window around the seam is encoded anew, and it
grows until the tokens outside are known to stay.

They are known to stay because of this: a sequence is the encoding of its bytes
if and only if each pair of neighbours is the encoding of its own bytes. (The
first merge that would cross a border of the sequence is also the first that
would cross it in the pair alone, since merges inside a token only depend on
that token.) So a window fits when its first token stands well beside the token
before it, and its last beside the token after it.

Decoding is concatenation: the bytes of a list are the product of the bytes of
its tokens, taken for a whole batch in one gather.

Null and empty texts give no ids; ids outside the vocabulary raise an error. A
text that is no valid Unicode can't be in a string column.
"""

from __future__ import annotations

import array
import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tokenmill.llm.common import Memo, extended, frugal, list_array, sub_batches

LEAF = 32
NONE = 1 << 30
#: Ids decoded at a time.
DECODED = 1 << 20


class ByteBpe:
    """Ranks of a byte-level vocabulary with encode."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.bytes = [ranks[bytes([i])] for i in range(256)]
        #: rank of the joined bytes of two tokens, by left * 2^32 + right
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.split = regex.compile(pattern).findall
        self.words = Memo(lambda word: self.encode_piece(" " + word))
        self.matches = Memo(lambda match: _packed(self.encode_match(match.encode())), 50_000)

    # -- leaves ----------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals."""
        if len(data) > 4 * LEAF:
            return self._merge_long(data)
        alone, get = self.bytes, self.pairs.get
        parts = [alone[x] for x in data]
        found = [get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while found:
            low = min(found)
            if low == NONE:
                break
            i = found.index(low)
            parts[i : i + 2] = (low,)
            del found[i]
            if i < len(found):
                found[i] = get(low << 32 | parts[i + 1], NONE)
            if i:
                found[i - 1] = get(parts[i - 1] << 32 | low, NONE)
        return parts

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap, for windows that had to grow far."""
        get, n = self.pairs.get, len(data)
        token = [self.bytes[x] for x in data]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := get(token[i] << 32 | token[j])) is not None:
                heapq.heappush(heap, (rank, i, token[i], token[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if token[i] != left or j >= n or token[j] != right:
                continue
            token[i], token[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in token if t >= 0]

    # -- joins -----------------------------------------------------------

    def stands(self, left: int, right: int) -> bool:
        """Whether the pair is the encoding of its own bytes."""
        return self.merge(self.tokens[left] + self.tokens[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left + right
        tokens = self.tokens
        i, j = len(left) - 1, 1
        while True:
            window = self.merge(b"".join(tokens[t] for t in left[i:] + right[:j]))
            left_fits = i == 0 or window[0] == left[i] or self.stands(left[i - 1], window[0])
            right_fits = (
                j == len(right)
                or window[-1] == right[j - 1]
                or self.stands(window[-1], right[j])
            )
            if left_fits and right_fits:
                return left[:i] + window + right[j:]
            if not left_fits:
                i = max(0, 2 * i - len(left))
            if not right_fits:
                j = min(len(right), 2 * j)

    def tree(self, data: bytes) -> list[int]:
        """Halves encoded apart, then joined."""
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    # -- texts -----------------------------------------------------------

    def encode_match(self, match: bytes) -> list[int]:
        """A match that is itself a token is that token."""
        whole = self.ranks.get(match)
        return self.tree(match) if whole is None else [whole]

    def encode_piece(self, text: str) -> bytes:
        """Ids, as int32, of a piece that begins and ends between matches."""
        matches = self.split(text)
        if len(matches) == 1:
            return _packed(self.encode_match(matches[0].encode()))
        words, others = self.words, self.matches
        return b"".join(
            words[m[1:]] if m[0] == " " and m[1:].isalpha() else others[m] for m in matches
        )

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as int32.

        A blank before a character that is no white space always begins a
        match, so the pieces between such blanks can be looked up.
        """
        first, *rest = BLANK.split(text) if AFTER_BLANK(text) else text.split(" ")
        return self.encode_piece(first) + b"".join(map(self.words.__getitem__, rest))


def _packed(ids: list[int]) -> bytes:
    return array.array("i", ids).tobytes()


#: A blank that is followed by white space or ends the text; then the blanks
#: that begin a match have to be looked for.
AFTER_BLANK = regex.compile(r" (?:\s|\Z)").search
BLANK = regex.compile(r" (?=\S)")

_loaded: dict[tuple[str, str], ByteBpe] = {}


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def bpe(data: bytes, pattern: str) -> ByteBpe:
    """The vocabulary of a rank file; one for each process."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _loaded:
        _loaded[key] = ByteBpe(load_ranks(data), pattern)
    return _loaded[key]


def token_bytes(data: bytes) -> pa.LargeBinaryArray:
    """Bytes of each id of a rank file; null where there is none."""
    ranks = load_ranks(data)
    by_id: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    return pa.array(by_id, pa.large_binary())


def decode_lists(tokens: pa.LargeBinaryArray, lists: pa.ListArray) -> pa.Array:
    """The joined bytes of each list of ids."""
    ends = np.zeros(len(lists) + 1, dtype=np.int64)
    sizes = pc.list_value_length(lists).fill_null(0)
    np.cumsum(np.asarray(sizes), out=ends[1:])
    taken = tokens.take(lists.flatten())
    if taken.null_count:
        raise ValueError("an id is not in the vocabulary")
    places = np.zeros(len(taken) + 1, dtype=np.int64)
    np.cumsum(np.asarray(pc.binary_length(taken)), out=places[1:])
    offsets = pa.py_buffer(places[ends].astype(np.int32))
    body = taken.buffers()[2] or pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, offsets, body])


def encode_texts(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    decode: bool = False,
) -> DataFrame:
    """Columns ``keep`` and ``ids`` (array of int) for each row; with
    ``decode`` also ``decoded``, the bytes the ids give back. The rank file is
    read here and sent to the tasks (under 1 MB for 50,000 tokens)."""
    with open(ranks_path, "rb") as file:
        data = file.read()
    kept = df.select(*keep, df[text_col].alias("_text"))
    if len(set(kept.columns)) != len(kept.columns):
        raise ValueError("give each kept column once")
    added = ["ids", *["decoded"] * decode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tokens = bpe(data, pattern).encode, token_bytes(data) if decode else None
        for batch in sub_batches(batches, "_text", 2 << 20):
            ids = [encode(x) if x else b"" for x in batch.column("_text").to_pylist()]
            values = np.frombuffer(b"".join(ids), dtype="<i4")
            lists = list_array(values, [len(x) // 4 for x in ids])
            made = [lists, *([decode_lists(tokens, lists)] if decode else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, *added])

    kinds = "ids array<int>" + ", decoded binary" * decode
    return kept.mapInArrow(frugal(run), extended(df, keep, kinds))


def _few_ids(batches: Iterator[pa.RecordBatch], ids_col: str) -> Iterator[pa.RecordBatch]:
    """Slices of about DECODED ids, or one longer list."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(ids_col)).fill_null(0)
        ends, start, base = np.cumsum(np.asarray(sizes, dtype=np.int64)), 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + DECODED, "right")))
            yield batch.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop


def decode_ids(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``decoded`` (binary): the bytes of their ids."""
    with open(ranks_path, "rb") as file:
        data = file.read()
    names = [*df.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(data)
        for batch in _few_ids(batches, ids_col):
            decoded = decode_lists(tokens, batch.column(ids_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=names)

    return df.mapInArrow(run, extended(df, df.columns, "decoded binary"))
