"""Packing by lexical retrieval: BM25 neighbours fill the window of a seed.

A document's ids are cut at the window's length; whole windows are sequences of
their own. What is left of each document, its rest, is packed with others:

* Rests are dealt into shards by their most telling token (greatest weight by
  the whole corpus), so that rests that share it meet; a token of very many
  rests is split over several shards by row, rare ones share a shard. Shards
  hold some ``SHARD`` rests.
* A shard has an inverted index over token ids with BM25 weights; the documents
  of each id and the mean length are those of all rests.
* The longest unused rest is the seed of a window. The unused rests, best score
  first, are placed whole where they fit, and the best of those left is cut to
  fill the window; its remainder stays in the shard. So only the last window of
  a shard may be short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import sub_batches, texts_of
from tokenmill.llm.encoders import byte_level_encoder
from tokenmill.scratch import new_path, stored, temporary_tables

WINDOW = 1024
SHARD = 1024
K1, B = 1.2, 0.75  # of BM25

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SEQUENCE = f"{PIECE}, sequence_id long, offset long"


# -- index -------------------------------------------------------------------


def inverse_frequency(documents: np.ndarray, total: int) -> np.ndarray:
    """Weight of each id that is in so many of all documents; what is in half
    of them or more weighs nothing."""
    return np.maximum(0.0, np.log((total - documents + 0.5) / (documents + 0.5)))


class Index:
    """Postings of BM25 weights over some rests."""

    def __init__(self, rests: list[np.ndarray], weights: np.ndarray, mean: float) -> None:
        sizes = np.array([len(r) for r in rests], dtype=np.int64)
        rest = np.repeat(np.arange(len(rests)), sizes)
        keys, times = np.unique(np.concatenate(rests).astype(np.int64) * len(rests) + rest, return_counts=True)
        ids, rest = keys // len(rests), keys % len(rests)
        told = weights[ids] > 0
        ids, self.rest, times = ids[told], rest[told], times[told]
        length = K1 * (1 - B + B * sizes / mean)
        self.weight = weights[ids] * times * (K1 + 1) / (times + length[self.rest])
        self.n = len(rests)
        heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
        self.first, self.last = heads, np.r_[heads[1:], len(ids)]
        #: for each rest the places of its ids in ``first``
        term = np.repeat(np.arange(len(heads)), self.last - heads)
        by = np.argsort(self.rest, kind="stable")
        self.terms = np.split(term[by], np.cumsum(np.bincount(self.rest, minlength=self.n))[:-1])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every rest for the ids of one."""
        terms = self.terms[seed]
        first = self.first[terms]
        n = self.last[terms] - first
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return np.bincount(self.rest[at], self.weight[at], self.n)


def filled(index: Index, sizes: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (rest, start within it, length)."""
    left = sizes.copy()
    while True:
        seed = int(left.argmax())
        if not left[seed]:
            return
        placed = [(seed, int(sizes[seed] - left[seed]), int(left[seed]))]
        room = window - int(left[seed])
        left[seed] = 0
        if room:
            unused = np.flatnonzero(left)
            ranked = unused[np.argsort(-index.scores(seed)[unused], kind="stable")]
            fits = ranked[left[ranked] <= room]
            while len(fits):  # as a whole
                one = int(fits[0])
                placed.append((one, int(sizes[one] - left[one]), int(left[one])))
                room -= int(left[one])
                left[one] = 0
                fits = fits[1:][left[fits[1:]] <= room]
            ranked = ranked[left[ranked] > 0]
            if room and len(ranked):
                one = int(ranked[0])
                placed.append((one, int(sizes[one] - left[one]), room))
                left[one] -= room
        yield placed


# -- jobs --------------------------------------------------------------------


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of every document: whole windows, and what is left with its
    ``ids`` as unsigned 32-bit integers (null for whole windows). A null text
    counts as empty; every document ends with ``end_id``."""
    with open(tokenizer_path, encoding="utf-8") as file:
        data = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level_encoder(data, True)
        end = np.array([end_id], dtype=np.uint32)
        for batch in sub_batches(batches, "_text"):
            rows = []
            for doc_id, text in zip(batch.column("_id").to_pylist(), texts_of(batch.column("_text"))):
                ids = np.concatenate([encoder.encode(text), end])
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rest = None if len(piece) == window else piece.astype("<u4").tobytes()
                    rows.append((doc_id, start, len(piece), _crc(piece), len(ids), rest))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECE.split(", ")] + ["ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"{PIECE}, ids binary")


def _rests(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("ids").to_pylist()]


def id_frequencies(rests: DataFrame) -> np.ndarray:
    """In how many of all rests each id is; as long as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids in _rests(batch):
                known = np.unique(ids)
                if known[-1] >= len(counts):
                    counts = np.pad(counts, (0, int(known[-1]) + 1 - len(counts)))
                counts[known] += 1
        known = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": pa.array(known, pa.int64()), "n": pa.array(counts[known], pa.int64())})

    rows = rests.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max((r["id"] for r in rows), default=0), dtype=np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def telling(ids: np.ndarray, weights: np.ndarray) -> int:
    """The id with the greatest sum of weights; ties: the least."""
    known, times = np.unique(ids, return_counts=True)
    return int(known[np.argmax(times * weights[known])])


def shards_of(counts: dict[int, int], n_ids: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """For each id the first of its shards and their number, so that a shard gets
    about ``shard`` rests at most."""
    base, number = np.zeros(n_ids, dtype=np.int64), np.ones(n_ids, dtype=np.int64)
    at, held = 0, 0
    for i in sorted(counts):
        if held and held + counts[i] > shard:
            at, held = at + 1, 0
        base[i] = at
        if counts[i] > shard:
            number[i] = -(-counts[i] // shard)
            at += int(number[i])
        else:
            held += counts[i]
    return base, number


def packed(
    docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW, shard: int = SHARD,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of
    every piece.

    Repeated ids and rows are documents of their own; an empty table gives no
    rows. Numbers of sequences are unique, not gapless.
    """
    spark = docs.sparkSession
    path = new_path(spark, "packed")
    with temporary_tables(spark):
        pieces = cut_documents(docs, tokenizer_path, end_id, window, id_col, text_col)
        pieces = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
        whole = pieces.where("ids IS NULL").drop("ids")
        whole = whole.withColumns({"sequence_id": 2 * F.col("_row") + 1, "offset": F.lit(0).cast("long")}).drop("_row")
        rests = pieces.where("ids IS NOT NULL")
        total, mean = rests.agg(F.count("*"), F.avg("length")).first()
        weights = inverse_frequency(id_frequencies(rests), total)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [telling(ids, weights) for ids in _rests(batch)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "_key"]
                )

        rests = stored(rests.mapInArrow(keyed, f"{PIECE}, ids binary, _row long, _key long"), "rests")
        counts = {r["_key"]: r["count"] for r in rests.groupBy("_key").count().collect()}
        base, number = shards_of(counts, len(weights), shard)
        known = np.array(sorted(counts), dtype=np.int64)
        places = pa.table({"_key": known, "_base": base[known], "_number": number[known]})
        rests = rests.join(F.broadcast(spark.createDataFrame(places)), "_key")  # as long as the vocabulary at most
        place = F.col("_base") + F.pmod(F.xxhash64("_row"), "_number")
        rests = rests.withColumn("_shard", place).drop("_key", "_base", "_number")

        def pack(table: pa.Table) -> pa.Table:
            # as the rows come in any order
            table = table.sort_by([("length", "descending"), ("_row", "ascending")])
            ids = [np.frombuffer(x, "<u4") for x in table.column("ids").to_pylist()]
            columns = {c: table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens")}
            first = table.column("_shard")[0].as_py() << 31
            rows = []
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            for k, one in enumerate(filled(Index(ids, weights, mean), sizes, window)):
                offset = 0
                for rest, start, length in one:
                    rows.append(
                        (
                            columns["doc_id"][rest],
                            columns["start"][rest] + start,
                            length,
                            _crc(ids[rest][start : start + length]),
                            columns["doc_tokens"][rest],
                            2 * (first + k),
                            offset,
                        )
                    )
                    offset += length
            return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[c.split()[0] for c in SEQUENCE.split(", ")])

        found = rests.groupBy("_shard").applyInArrow(pack, SEQUENCE)
        found = whole.unionByName(found)
        found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)
