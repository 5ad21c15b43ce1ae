"""Alignment of two tokenizers by divide and conquer at shared cuts.

Both tokenizers cut the same bytes. A place where a token of each ends is a
shared cut. An interval between two shared cuts is halved: from its middle token
outwards each end of the first tokenizer is looked up among the ends of the
second by bisection, until one is shared; both parts are then treated alike. An
interval without a shared cut inside is a group. The intervals of all texts of a
batch are handled together, one probe of each at a time.

Within a group the tokens of both sides follow each other by their ends, which
gives the links: each stretch of bytes between two neighbouring ends lies in one
token of each side. How many documents hold a pair of ids is counted over the
corpus; the pairs of most documents, a bounded number (``HOT``), are then
broadcast, and what is left of each document is joined by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import sub_batches, texts_of
from tokenmill.llm.encoders import ByteLevelEncoder, PieceEncoder, byte_level_encoder, piece_encoder
from tokenmill.operators.dictionary import frequency_bins
from tokenmill.scratch import new_path, stored, temporary_tables

HOT = 500_000  # pairs that are broadcast
BATCH = 2 << 20  # bytes of text that are aligned together


# -- cuts --------------------------------------------------------------------


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ends_a`` and ``ends_b`` of all their common values, in order.
    Both ascend, and their last values are equal."""
    if not len(ends_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # between lo and hi (itself a cut) no end has been found shared yet
    lo, hi = np.zeros(1, np.int64), np.array([len(ends_a) - 1])
    tries = np.zeros(1, np.int64)
    found = [hi]
    while len(lo):
        step = (tries + 1) // 2
        at = (lo + hi - 1) // 2 + np.where(tries % 2, step, -step)
        inside = (at >= lo) & (at < hi)
        probe = np.where(inside, at, 0)
        value = ends_a[probe]
        hit = inside & (ends_b[np.searchsorted(ends_b, value)] == value)
        found.append(at[hit])
        open_ = ~hit & (2 * step <= hi - lo + 1)
        # both parts of what was cut, in their place: ordered probes are found faster
        source = np.repeat(np.arange(len(lo)), 2 * hit + open_)
        first = np.r_[True, source[1:] != source[:-1]][: len(source)]
        cut = hit[source]
        lo = np.where(cut & ~first, at[source] + 1, lo[source])
        hi = np.where(cut & first, at[source], hi[source])
        tries = np.where(cut, 0, tries[source] + 1)
        wide = lo < hi
        lo, hi, tries = lo[wide], hi[wide], tries[wide]
    cuts = np.sort(np.concatenate(found))
    return cuts, np.searchsorted(ends_b, ends_a[cuts])


class Aligner:
    """Two encoders over the same texts, and the tables their alignment needs."""

    def __init__(self, first: ByteLevelEncoder, second: PieceEncoder) -> None:
        self.first, self.second = first, second
        self.sizes = [np.array([len(t) for t in e.tokens], dtype=np.int64) for e in (first, second)]
        self.flat = [np.frombuffer(b"".join(e.tokens), dtype=np.uint8) for e in (first, second)]
        self.starts = [np.cumsum(size) - size for size in self.sizes]
        self.width = len(second.tokens)
        most = max(map(len, self.sizes))
        #: decimal ids, followed by what stands between two tokens
        self.names = [b"%d%s" % (i, end) for end in (b",", b"|", b";", b"") for i in range(most)]
        self.most = most

    def _bytes(self, side: int, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, one after the other."""
        sizes = self.sizes[side][ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[side][np.arange(total) + np.repeat(self.starts[side][ids] - (ends - sizes), sizes)]

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both for each text; none where the text is empty or the tokens
        do not give its bytes back."""
        none = np.zeros(0, dtype=np.uint32)
        raw = [(" " + t).encode() if t else b"" for t in texts]
        sides = [
            [self.first.encode(" " + t) if t else none for t in texts],
            [self.second.encode(t) if t else none for t in texts],
        ]
        kept = np.ones(len(texts), dtype=bool)
        for side, ids in enumerate(sides):
            kept &= np.array([self.sizes[side][x].sum() for x in ids]) == np.array([len(r) for r in raw])
        # of equal length: all bytes beside each other
        some = np.flatnonzero(kept).tolist()
        ends = np.cumsum([len(raw[i]) for i in some])
        wanted = np.frombuffer(b"".join([raw[i] for i in some]), dtype=np.uint8)
        for side, ids in enumerate(sides):
            given = self._bytes(side, np.concatenate([none, *(ids[i] for i in some)]))
            odd = np.searchsorted(ends, np.flatnonzero(given != wanted), "right")
            kept[[some[k] for k in np.unique(odd).tolist()]] = False
        return tuple([x if keep else none for x, keep in zip(ids, kept.tolist())] for ids in sides)

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """For each text the numbers of tokens, groups and links and the digest
        of the groups; its distinct pairs of linked ids and how often."""
        sides = self.ids(texts)
        n_a, n_b = (np.array([len(x) for x in side], dtype=np.int64) for side in sides)
        none = np.zeros(0, dtype=np.uint32)
        a, b = (np.concatenate([none, *side]).astype(np.int64) for side in sides)
        ends_a, ends_b = (np.cumsum(size[x], dtype=np.int64) for size, x in zip(self.sizes, (a, b)))
        total = int(ends_a[-1]) if len(a) else 0
        kind = np.int32 if total < 2**31 else np.int64
        cut_a, cut_b = shared_cuts(ends_a.astype(kind), ends_b.astype(kind))
        owner = np.repeat(np.arange(len(texts)), n_a)
        groups = np.bincount(owner[cut_a], minlength=len(texts))
        # each stretch between two neighbouring ends is in one token of each side
        here = np.zeros((2, total + 1), dtype=bool)
        here[0, ends_a], here[1, ends_b] = True, True
        ends = np.flatnonzero(here.any(axis=0))
        link_a, link_b = (np.cumsum(h[ends]) - h[ends] for h in here)
        of = owner[link_a]
        links = np.bincount(of, minlength=len(texts))
        codes = a[link_a] * self.width + b[link_b]
        space = len(self.first.tokens) * self.width
        pairs, counts = np.unique(of * space + codes, return_counts=True)
        n_pairs = np.bincount(pairs // space, minlength=len(texts)) if len(pairs) else np.zeros(len(texts), np.int64)
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": groups,
            "n_links": links,
            "digest": self._digests(a, b, n_a, n_b, cut_a, cut_b),
            "pair": pairs % space,
            "times": counts,
            "n_pairs": n_pairs,
        }

    def _digests(self, a, b, n_a, n_b, cut_a, cut_b) -> list[str]:
        """sha256 of the groups' ids as text; empty without tokens."""
        a_group = np.repeat(np.arange(len(cut_a)), np.diff(cut_a, prepend=-1))
        b_group = np.repeat(np.arange(len(cut_b)), np.diff(cut_b, prepend=-1))
        before = np.r_[0, cut_b[:-1] + 1] if len(cut_b) else cut_b
        # a group's ids of the first side, then those of the second
        place_a, place_b = np.arange(len(a)) + before[a_group], np.arange(len(b)) + cut_a[b_group] + 1
        named = np.empty(len(a) + len(b), dtype=np.int64)
        named[place_a], named[place_b] = a, b
        named[place_a[cut_a]] += self.most
        named[place_b[cut_b]] += 2 * self.most
        stops = np.cumsum(n_a + n_b)
        named[stops[n_a > 0] - 1] += self.most
        out = []
        for start, stop in zip((stops - n_a - n_b).tolist(), stops.tolist()):
            text = b"".join(map(self.names.__getitem__, named[start:stop].tolist()))
            out.append(hashlib.sha256(text).hexdigest() if text else "")
        return out


_aligners: dict[tuple[int, int], Aligner] = {}


def aligner(first: ByteLevelEncoder, second: PieceEncoder) -> Aligner:
    """One for each process."""
    key = id(first), id(second)
    if key not in _aligners:
        _aligners[key] = Aligner(first, second)
    return _aligners[key]


# -- jobs --------------------------------------------------------------------


def _files(first_path: str, second_path: str) -> tuple[str, bytes]:
    with open(first_path, encoding="utf-8") as first, open(second_path, "rb") as second:
        return first.read(), second.read()


def aligned(docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and ``pairs`` (distinct
    pairs of linked ids as one number, and how often) of each row.

    The first tokenizer is a byte-level BPE file of the tokenizers library and
    encodes a blank and the text, the second a sentencepiece model, which adds
    the blank itself. Null and empty texts have no tokens, nor have texts that
    either's tokens do not give back.
    """
    first, second = _files(first_path, second_path)
    sizes = [len(e.tokens) for e in (byte_level_encoder(first, False), piece_encoder(second))]
    kind = pa.int32() if sizes[0] * sizes[1] < 2**31 else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_level_encoder(first, False), piece_encoder(second))
        for batch in sub_batches(batches, "_text", BATCH):
            got = both.align(texts_of(batch.column("_text")))
            fields = pa.StructArray.from_arrays(
                [pa.array(got["pair"], kind), pa.array(got["times"], pa.int32())], names=["pair", "times"]
            )
            offsets = pa.array(np.r_[0, np.cumsum(got["n_pairs"])], pa.int32())
            counts = [pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    *counts,
                    pa.array(got["digest"], pa.string()),
                    pa.ListArray.from_arrays(offsets, fields),
                ],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    schema = (
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
        f"pairs array<struct<pair: {'int' if kind == pa.int32() else 'bigint'}, times: int>>"
    )
    return rows.mapInArrow(run, schema)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """``pair``, ``n_occ`` (the documents that hold it) and ``best`` (whether no
    other pair of its first id is in more); ``width`` is the number of ids of
    the second side."""
    counts = rows.select(F.explode("pairs.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_occ"))
    counts = stored(counts.withColumn("_a", F.floor(F.col("pair") / width)), "pair-counts")
    most = counts.groupBy("_a").agg(F.max("n_occ").alias("_most"))
    return stored(counts.join(most, "_a").select("pair", "n_occ", (F.col("n_occ") == F.col("_most")).alias("best")), "pairs")


def hot_pairs(counts: DataFrame, hot: int = HOT) -> int | None:
    """The least count so that all pairs with it or more are ``hot`` at most;
    None if there is none. Read off a histogram of two leading digits."""
    rows, least = 0, None
    for one in sorted(frequency_bins(counts).collect(), key=lambda r: -r["least"]):
        rows += one["rows"]
        if rows > hot:
            break
        least = one["least"]
    return least


def cross_aligned(
    docs: DataFrame, first_path: str, second_path: str, hot: int = HOT,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, a
    row for each row of the input.

    ``n_best`` are the links whose pair is in as many documents as any pair of
    its first id, ``count_sum`` adds up the documents of the pairs of all links.
    Repeated ids and texts are documents of their own.
    """
    spark = docs.sparkSession
    path = new_path(spark, "aligned")
    with temporary_tables(spark):
        rows = aligned(docs, first_path, second_path, id_col, text_col)
        rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "alignment")
        width = len(piece_encoder(_files(first_path, second_path)[1]).tokens)
        counts = pair_counts(rows, width)
        least = hot_pairs(counts, hot)
        frequent = F.lit(False) if least is None else F.col("n_occ") >= least
        often, rare = F.broadcast(counts.where(frequent)), counts.where(~frequent)
        links = rows.select("_row", F.explode("pairs").alias("_p")).select("_row", "_p.pair", "_p.times")
        sums = [
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n_occ")).alias("count_sum"),
        ]
        near = links.join(often, "pair").groupBy("_row").agg(*sums)
        far = links.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(rare, "pair")
        both = near.unionByName(far.groupBy("_row").agg(*sums))
        total = both.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        found = rows.drop("pairs").join(total, "_row", "left").select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links",
            F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
            F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
            "groups_sha256",
        )
        found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)
