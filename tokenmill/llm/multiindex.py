"""Exact k nearest binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into m segments. If two codes differ in at most
m * (r + 1) - 1 bits, one of the segments differs in at most r. So a query
probes, for r = 0, 1, 2, ..., every segment value r bits away from its own in
each segment's index, verifies the whole codes it meets, and is done as soon as
its k-th verified distance is at most what the radii so far cover. The radius
grows by one segment at a time: with r + 1 done in the first b segments, all
distances up to m * (r + 1) + b - 1 are covered.

Segments are nearly as wide as the number of codes needs (log2 of it), so that an
index cell holds few codes. Only candidates within a query's bound, the k-th distance
it has so far, leave the join, never all that were met. Every query ends by its
covered radius, at every size of the table.

Equal codes are one: an index entry holds a code with its least k + 1 ids, as
many as any query can use, so neither a code of a third of all rows nor as many
equal queries cost more than one. Queries that share a code are searched once.

A vector's code is the signs of its elements (above zero: 1) when it has 64, of
fixed random sums of them otherwise. Rows with a null id or vector are left out;
nulls and NaN inside a vector count as 0. Repeated ids are one neighbour at the
least of their distances. Ties go to the lesser id. Queries with fewer than k
other rows get as many as there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.scratch import stored

BITS = 64
#: Least width of a segment.
WIDTH = 4
#: Bits that a segment has less than the number of codes: some codes in a cell
#: cost less than the probes of larger radii in wider segments.
SPARE = 2
#: Radii are probed together while a query needs no more probes than this.
FEW = 1024
#: Probes that a task makes, about.
PROBES = 1 << 20


def signs(vectors: list[np.ndarray]) -> np.ndarray:
    """64-bit codes, as signed numbers, of vectors of one length."""
    values = np.nan_to_num(np.stack(vectors).astype(np.float64))
    n = values.shape[1]
    if n != BITS:
        values = values @ np.random.default_rng(n).choice([-1.0, 1.0], (n, BITS))
    return np.packbits(values > 0, axis=1).view(">i8").reshape(-1).astype(np.int64)


def sign_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and code of the rows that have both."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("id").to_pylist(), batch.column("v")
            by_length: dict[int, tuple[list, list]] = {}
            for i, id_ in enumerate(ids):
                if id_ is None or not lists[i].is_valid:
                    continue
                vector = np.asarray(lists[i].values.to_numpy(zero_copy_only=False), dtype=np.float32)
                same = by_length.setdefault(len(vector), ([], []))
                same[0].append(id_)
                same[1].append(vector)
            for same_ids, vectors in by_length.values():
                yield pa.RecordBatch.from_pydict({"id": pa.array(same_ids, pa.int64()), "code": pa.array(signs(vectors))})

    return rows.mapInArrow(run, "id long, code long")


def segments(n_codes: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment, for that many codes."""
    width = max(WIDTH, min(BITS // 2, round(log2(max(2, n_codes))) - SPARE))
    count = -(-BITS // width)
    widths = [BITS // count + (i < BITS % count) for i in range(count)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def ring(width: int, radius: int) -> np.ndarray:
    """Masks with ``radius`` of ``width`` bits."""
    return np.array([sum(1 << i for i in bits) for bits in combinations(range(width), radius)], dtype=np.int64)


def _probes(queries: DataFrame, cuts: list[tuple[int, int]], radii: list[int]) -> DataFrame:
    """q, bound, segment s and every value v of it at one of the radii from the
    query's own, but for those that the query's bound makes needless."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {(w, r): ring(w, r) for _, w in cuts for r in radii}
        for batch in batches:
            q, bound = (np.asarray(batch.column(c)) for c in ("q", "bound"))
            for i, (shift, width) in enumerate(cuts):
                own = (q.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
                for r in radii:
                    # what smaller radii and the segments before cover may do
                    asking = np.flatnonzero(bound > len(cuts) * r + i - 1)
                    ring_ = masks[width, r]
                    if not len(ring_):  # a narrower segment has no such values
                        continue
                    step = max(1, (1 << 18) // len(ring_))
                    for at in range(0, len(asking), step):
                        some = asking[at : at + step]
                        values = (own[some][:, None] ^ ring_[None, :]).ravel()
                        columns = [np.repeat(q[some], len(ring_)), np.repeat(bound[some], len(ring_))]
                        columns += [np.full(len(values), i, dtype=np.int32), values]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "bound", "s", "v"])

    return queries.select("q", "bound").mapInArrow(run, "q long, bound int, s int, v long")


def _least(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k least (dist, id) of each key. Tasks keep k of a key before the
    exchange."""
    order = Window.partitionBy(key).orderBy("dist", "id")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def nearest(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """For each row (id, code) of ``queries`` its k nearest others among the
    rows of ``codes``: query_id, rank, id and distance."""
    want = k + 1  # one may be the query itself
    codes = stored(codes.select("id", "code").distinct(), "near-codes")
    asked = stored(queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct(), "near-asked")
    first = Window.partitionBy("code").orderBy("id")
    index = codes.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= want)
    index = stored(index.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "near-index")
    cuts = segments(index.count())
    spark = codes.sparkSession
    open_ = stored(asked.select("q").distinct(), "near-open")
    best = spark.createDataFrame([], "q long, dist int, id long")
    found: DataFrame | None = None
    covered = -1
    parts = index.select(
        "code", "ids", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), _cut("code", *c).alias("v")) for i, c in enumerate(cuts)])).alias("p")
    ).select("p.s", "p.v", "code", "ids")
    radius = 0
    while True:
        # a query is done when its k-th distance is covered
        bounds = best.groupBy("q").agg(F.max("dist").alias("far"), F.count("*").alias("_n"))
        bounds = bounds.select("q", F.when(F.col("_n") < want, BITS).otherwise(F.col("far")).alias("bound"))
        bounds = open_.join(bounds, "q", "left").select("q", F.coalesce("bound", F.lit(BITS)).alias("bound"))
        bounds = stored(bounds, "near-bounds")
        done = bounds.where(F.col("bound") <= covered).select("q")
        finished = best.join(done, "q", "left_semi")
        found = finished if found is None else found.unionByName(finished)
        live = bounds.where(F.col("bound") > covered)
        n_live = live.count()
        if not n_live:
            break
        best = best.join(live.select("q"), "q", "left_semi")
        open_ = live.select("q")
        radii = [radius]
        while radii[-1] < cuts[0][1] and sum(comb(w, r) for _, w in cuts for r in (*radii, radii[-1] + 1)) <= FEW:
            radii.append(radii[-1] + 1)
        probes = sum(comb(w, r) for _, w in cuts for r in radii)
        live = live.repartition(1 + n_live * probes // PROBES)
        dist = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        met = (
            _probes(live, cuts, radii)
            # probes pack so well that their size on disk invites a broadcast
            .join(parts.hint("merge"), ["s", "v"])
            .where(dist <= F.col("bound"))
            .select("q", dist.alias("dist"), "code", "ids")
            .dropDuplicates(["q", "code"])
            .select("q", "dist", F.explode("ids").alias("id"))
        )
        both = best.unionByName(_least(met, "q", want)).groupBy("q", "id").agg(F.min("dist").alias("dist"))
        best = stored(_least(both.select("q", "dist", "id"), "q", want), "near-best")
        radius = radii[-1] + 1
        covered = len(cuts) * radius - 1
    both = asked.join(found, "q").where(F.col("id") != F.col("query_id"))
    both = both.groupBy("query_id", "id").agg(F.min("dist").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "distance")


def _cut(column: str, shift: int, width: int):
    """Bits of a segment."""
    return F.shiftrightunsigned(F.col(column), shift).bitwiseAND((1 << width) - 1)
