"""Spelling variants: words one edit apart, by k-d trees over letter counts.

A word is the vector of its letter counts. One inserted code point adds one to
one count; one replaced code point takes one off a count and adds one to
another; so near words are at an L1 distance of at most two, and what a search
may leave out is ruled by that: a word looks for words of its own length with
one step up and one step down, and for words one longer with one step up. The
words one shorter find it themselves.

Each length has a tree. Its upper part is fitted on a bounded sample of the
words (``SAMPLE``), which only sets where the planes lie; every word is then
placed in the one leaf whose box holds it, and sent as a query to each leaf
whose box its steps can reach. A leaf is one group of some ``LEAF`` words: its
task goes on with a tree of its own down to a few words, prunes by the same
rule, compares signatures and then the order of letters. Words whose counts are
all equal (anagrams) cannot be parted by planes and share the last box.

Letters are counted in 26 places for a-z and 64 for all others, by code point;
letters that share a place only bring vectors closer, so no pair is lost. Words
of ``LONG`` and more code points share one tree, whose searches take both steps
both ways.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import sub_batches
from tokenmill.scratch import new_path, stored, temporary_tables

RUN = re.compile("[a-zÀ-ÿ]+")
MODULUS = 97
MIN_LENGTH = 5
MIN_COUNT = 3
PLACES = 26 + 64
LONG = 64
SAMPLE = 100_000  # words of all lengths on which planes are fitted
LEAF = 4096  # words of a group, about
BOX = 16  # words that are compared without a further plane
HELD = 200_000  # distinct words that a task counts before it sends them on
PAIRS = 1 << 20  # pairs compared at once


# -- words -------------------------------------------------------------------


def runs_of(doc_id: int | None, text: str | None) -> Counter:
    """Runs of letters with A-Z lowered, and how often. A run whose crc32 after
    the id and a colon is a multiple of MODULUS loses one code point."""
    counts: Counter = Counter()
    if not text:
        return counts
    begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(run.encode(), begin)
        if h % MODULUS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        counts[run] += n
    return counts


def word_table(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
) -> DataFrame:
    """``word`` and ``n`` of the words long and frequent enough. Null and empty
    texts have no words; a null id counts as empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sent() -> pa.RecordBatch:
            columns = {"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())}
            held.clear()
            return pa.RecordBatch.from_pydict(columns)

        for batch in sub_batches(batches, "_text"):
            for doc_id, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
                for word, n in runs_of(doc_id, text).items():
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield sent()
        if held:
            yield sent()

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counts = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


# -- vectors and trees -------------------------------------------------------


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and the words' lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), lengths


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of PLACES counts for each word, 255 at most."""
    points, lengths = code_points(words)
    places = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % 64).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(owner * PLACES + places, minlength=len(words) * PLACES)
    return np.minimum(counts, 255).astype(np.uint8).reshape(len(words), PLACES)


def signatures(vectors: np.ndarray) -> np.ndarray:
    """64 bits of each vector: a letter of a-z there, there twice, and others in
    12 bits. One step of one count changes one bit at most."""
    others = vectors[:, 26:].astype(np.int64)
    folded = np.stack([others[:, k::12].any(axis=1) for k in range(12)], axis=1)
    bits = np.concatenate([vectors[:, :26] > 0, vectors[:, :26] > 1, folded], axis=1)
    return np.packbits(bits, axis=1).view(np.uint64).reshape(-1)


def plane(vectors: np.ndarray) -> tuple[int, int] | None:
    """Place and greatest count of the lower side that halve the rows best;
    None if all rows are equal."""
    best, found = len(vectors), None
    for t in range(3):
        low = (vectors <= t).sum(axis=0)
        off = np.abs(2 * low - len(vectors))
        off[(low == 0) | (low == len(vectors))] = len(vectors)
        at = int(off.argmin())
        if off[at] < best:
            best, found = int(off[at]), (at, t)
    if found is None:  # only counts above three differ
        least = vectors.min(axis=0)
        apart = np.flatnonzero(vectors.max(axis=0) > least)
        if len(apart):
            found = int(apart[0]), int(least[apart[0]])
    return found


class Tree:
    """Planes over vectors; a leaf has a number. ``nodes`` holds (place, count,
    lower node, upper node), or (-1, leaf, 0, 0)."""

    def __init__(self, vectors: np.ndarray, leaf: float) -> None:
        """Planes until at most ``leaf`` of the rows are together; ``rows``
        holds those of each leaf."""
        self.nodes: list[tuple[int, int, int, int]] = []
        self.rows: list[np.ndarray] = []
        stack = [(np.arange(len(vectors)), -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            number = len(self.nodes)
            if parent >= 0:
                node = list(self.nodes[parent])
                node[side] = number
                self.nodes[parent] = tuple(node)
            part = vectors[rows]
            cut = plane(part) if len(rows) > leaf else None
            if cut is None:
                self.nodes.append((-1, len(self.rows), 0, 0))
                self.rows.append(rows)
                continue
            lower = part[:, cut[0]] <= cut[1]
            self.nodes.append((*cut, 0, 0))
            stack += [(rows[lower], number, 2), (rows[~lower], number, 3)]

    def reached(
        self, vectors: np.ndarray, up: bool, down: bool | np.ndarray
    ) -> Iterator[tuple[int, np.ndarray]]:
        """Leaf and the rows whose vectors lie in its box after one step up (of
        a count) and one down at most, as allowed. Without either, each row
        reaches its own leaf alone."""
        none = np.zeros(len(vectors), dtype=bool)
        stack = [(0, np.arange(len(vectors)), none | up, none | down)]
        while stack:
            number, rows, up_left, down_left = stack.pop()
            if not len(rows):
                continue
            at, t, lower, upper = self.nodes[number]
            if at < 0:
                yield t, rows
                continue
            x = vectors[rows, at]
            inside = x <= t
            left = inside | (down_left & (x == t + 1))
            right = ~inside | (up_left & (x == t))
            stack.append((lower, rows[left], up_left[left], (down_left & inside)[left]))
            stack.append((upper, rows[right], (up_left & ~inside)[right], down_left[right]))


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``a`` ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def same_order(words: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """one_edit for pairs of places in ``words``; ``b`` is not the shorter."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    good = np.zeros(len(a), dtype=bool)
    far = np.flatnonzero(lengths[b] > LONG)
    for i in far.tolist():
        good[i] = one_edit(words[a[i]], words[b[i]])
    near = np.flatnonzero(lengths[b] <= LONG)
    if len(near):
        a, b = a[near], b[near]
        known, number = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = number[: len(a)], number[len(a) :]
        few = [words[i] for i in known.tolist()]
        points, lengths = code_points(few)
        width = int(lengths.max()) + 1
        inside = np.arange(width) < lengths[:, None]
        begin = np.zeros((len(few), width), dtype=np.uint32)
        end = np.zeros((len(few), width), dtype=np.uint32)
        begin[inside] = points  # at the left
        end[inside[:, ::-1]] = points  # at the right
        # equal code points from the left and from the right
        prefix = (begin[a] != begin[b]).argmax(axis=1)
        suffix = (end[a] != end[b])[:, ::-1].argmax(axis=1)
        shorter, gap = lengths[a], lengths[b] - lengths[a]
        equal = (begin[a] == begin[b]).all(axis=1)
        good[near] = ~equal & (
            ((gap == 0) & (prefix + suffix == shorter - 1)) | ((gap == 1) & (prefix + suffix >= shorter))
        )
    return good


def near_pairs(words: list[str], n_data: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of queries and of the near words they find.

    The first ``n_data`` words are those of the leaf. All words are queries;
    they find words of their length and of one more."""
    vectors = letter_counts(words)
    marks = signatures(vectors)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    tree = Tree(vectors[:n_data], BOX)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    down = (lengths == lengths[0]) | (lengths >= LONG)
    for leaf, queries in tree.reached(vectors, True, down):
        data = tree.rows[leaf]
        step = max(1, PAIRS // len(data))
        for start in range(0, len(queries), step):
            q = queries[start : start + step]
            far = np.bitwise_count(marks[q][:, None] ^ marks[data])
            gap = lengths[data] - lengths[q][:, None]
            a, b = np.nonzero((far <= 2 - gap.clip(0, 1)) & ((gap == 0) | (gap == 1)))
            held.append((q[a], data[b]))
            size += len(a)
            if size >= PAIRS:
                yield _verified(words, held)
                held, size = [], 0
    if held:
        yield _verified(words, held)


def _verified(words: list[str], held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(x) for x in zip(*held))
    good = same_order(words, a, b)
    return a[good], b[good]


FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

# -- jobs --------------------------------------------------------------------


def _class(length: int) -> int:
    return min(length, LONG)


def fitted_trees(words: DataFrame, sample: int = SAMPLE, leaf: int = LEAF) -> dict[int, tuple[Tree, int]]:
    """The upper tree of each length and the number of its first leaf; lengths
    are LONG at most, so there are as many trees at most."""
    kind = F.least(F.char_length("word"), F.lit(LONG)).alias("kind")
    totals = {r["kind"]: r["count"] for r in words.groupBy(kind).count().collect()}
    total = sum(totals.values())
    low = F.xxhash64("word").bitwiseAND((1 << 31) - 1)
    share = min(1.0, sample / max(total, 1))
    rows = words.where(low < int(share * 2**31)).orderBy(low, "word").limit(2 * sample).collect()
    by_kind: dict[int, list[str]] = {k: [] for k in totals}
    for r in rows:
        by_kind[_class(len(r["word"]))].append(r["word"])
    trees, first = {}, 0
    for k, some in sorted(by_kind.items()):
        tree = Tree(letter_counts(some), max(1.0, leaf * len(some) / totals[k]))
        leaves = len(tree.rows)
        tree.rows = []
        trees[k], first = (tree, first), first + leaves
    return trees


def near_counts(words: DataFrame, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """``word``, ``n_near`` and the near word of largest ``n`` (``near``,
    ``near_n``; ties: the first) of each word that has one. ``words`` holds
    distinct words and their ``n``."""
    trees = fitted_trees(words, sample, leaf)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word once in its own leaf (``own``) and as a query in every other
        leaf that its steps reach."""
        for batch in batches:
            texts = batch.column("word").to_pylist()
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                vectors = letter_counts([texts[i] for i in rows.tolist()])
                kind = _class(length)
                tree, first = trees[kind]
                homes = np.empty(len(rows), dtype=np.int64)
                for number, some in tree.reached(vectors, False, False):
                    homes[some] = first + number
                yield _sent(batch, rows, homes, 0)
                for number, some in tree.reached(vectors, True, True):
                    away = some[homes[some] != first + number]
                    yield _sent(batch, rows[away], np.full(len(away), first + number), 1)
                if kind < LONG and length + 1 in trees:
                    tree, first = trees[length + 1]
                    for number, some in tree.reached(vectors, True, False):
                        yield _sent(batch, rows[some], np.full(len(some), first + number), 1)

    def compared(table: pa.Table) -> pa.Table:
        table = table.sort_by([("role", "ascending"), ("word", "ascending")])
        texts = table.column("word").to_pylist()
        n = table.column("n").to_numpy()
        n_data = int((table.column("role").to_numpy() == 0).sum())
        out = [pa.RecordBatch.from_pylist([], FOUND)]
        order = np.empty(len(texts), dtype=np.int64)
        order[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        for a, b in near_pairs(texts, n_data) if n_data else ():
            longer = lengths[b] > lengths[a]
            # words of one length find each other; a longer one is told
            word, near = np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])
            if not len(word):
                continue
            by = np.lexsort((order[near], -n[near], word))
            word, near = word[by], near[by]
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[heads, len(word)])
            columns = [
                pa.array([texts[i] for i in word[heads].tolist()], pa.string()),
                pa.array(counts.astype(np.int64)),
                pa.array([texts[i] for i in near[heads].tolist()], pa.string()),
                pa.array(n[near[heads]].astype(np.int64)),
            ]
            out.append(pa.RecordBatch.from_arrays(columns, schema=FOUND))
        return pa.Table.from_batches(out)

    rows = words.select("word", "n").mapInArrow(placed, "leaf long, role int, word string, n long")
    found = rows.groupBy("leaf").applyInArrow(compared, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n")
    )


def _sent(batch: pa.RecordBatch, rows: np.ndarray, leaves: np.ndarray, role: int) -> pa.RecordBatch:
    at = pa.array(rows)
    columns = {
        "leaf": pa.array(leaves),
        "role": pa.array(np.full(len(rows), role, dtype=np.int32)),
        "word": batch.column("word").take(at),
        "n": batch.column("n").take(at),
    }
    return pa.RecordBatch.from_pydict(columns)


def last_forms(links: DataFrame) -> DataFrame:
    """``word`` and ``root``: where ``form`` leads in the end, for the words
    that have one. ``n`` at least doubles with each step, so there are no
    circles, and pointers are doubled in a few rounds."""
    roots = stored(links.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = roots.join(further, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
        )
        new = stored(new, "word-roots")
        roots = new.select("word", "root")
        if not new.where("_moved").limit(1).count():
            return roots


def word_forms(words: DataFrame, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of a table of
    distinct words and their ``n``.

    ``form`` is the near word of largest ``n`` if that is at least twice the
    word's, else null; ``root`` the last of the forms, the word itself if it has
    none. An empty table gives no rows.
    """
    near = near_counts(words, sample, leaf)
    doubled = F.col("near_n") >= 2 * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word",
        F.when(doubled, F.col("near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(doubled, F.col("near_n")).alias("form_n"),
    )
    rows = stored(rows, "word-forms")
    roots = last_forms(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, **columns: str) -> DataFrame:
    """``word_forms`` of the words of all documents. Ids may repeat; other
    columns are not read."""
    spark = docs.sparkSession
    path = new_path(spark, "spelling")
    with temporary_tables(spark):
        found = word_forms(stored(word_table(docs, **columns), "words"))
        found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)
