"""Mixing sources to target weights by a low-discrepancy schedule.

The golden-ratio points frac(t * phi), t = 0, 1, 2, ..., are mapped through the
cumulative target weights of the sources: slot t draws from the source whose
interval holds the point. So every stretch of the mix, long or short, has the
sources close to their weights. Slots are ranked within their source, and rank
r takes block r of the source: its documents in hash order, laid end to end and
cut into blocks of equal words (the last block of a source may be short). After
its last block a source begins again.

A source takes slots until its quota, the number of blocks nearest its target,
is full; the few slots that the points leave open come at the end. So a
source's words are within one block of its target, and as no target is
above twice its source, no document is taken more than twice.

Where a document lies in its source is a running sum, taken over a range
exchange: tasks sum their ranges, the sums of the ranges (one for each task and
source) are added up, so a source of a third of all rows is spread. The ranks
of the slots come the same way from runs of ``RUN`` slots.

Nulls: a null text has size 0, a null source is a source of its own and comes
last. Sources without a word have target 0. Documents without a word, and all
documents of an empty table, are taken 0 times. The result depends on the rows
alone, not on their order or partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenmill.llm.common import WORD, extended
from tokenmill.scratch import stored

#: Words of a block.
BLOCK_WORDS = 128
#: The golden ratio's fraction times 2^64: the points are exact whole numbers,
#: and the product wraps as it should.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Slots of a task.
RUN = 1 << 18


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """``share`` of all sizes dealt by weight; what is above ``cap`` times a
    source's size is dealt anew among the others until none is above."""
    out = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s]
    rest = share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in full:
            out[i] = cap * sizes[i]
        rest -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


def quota(size: int, target: float, block: int) -> int:
    """Slots whose blocks hold the target's words best."""
    if not size:
        return 0
    blocks = -(-size // block)
    rounds, rest = divmod(target, size)
    low = min(int(rest // block), blocks)
    words = [min(size, n * block) for n in (low, low + 1)]
    return int(rounds) * blocks + (low if rest - words[0] <= words[1] - rest else low + 1)


def _laid_out(docs: DataFrame) -> DataFrame:
    """Each document's first place among the words of its source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, base = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            source = np.asarray(batch.column("_s"))
            size = np.asarray(batch.column("size"))
            ends = np.cumsum(size)
            first = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]]))
            start = ends - size
            lead = -start[first]
            if source[0] == last:
                lead[0] += base
            start = start + np.repeat(lead, np.diff(np.append(first, len(source))))
            last, base = source[-1], int(start[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start)], names=[*batch.schema.names, "_at"])

    order = ["_s", "_h", "doc_id", "size"]
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    summed = ranged.mapInArrow(run, extended(docs, docs.columns, "_at long")).withColumn("_part", F.spark_partition_id())
    summed = stored(summed, "mix-places")
    parts = summed.groupBy("_s", "_part").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_s", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # at most tasks + sources rows
    return summed.join(F.broadcast(parts), ["_s", "_part"]).withColumn("_at", F.col("_at") + F.col("_base")).drop("_base", "_part")


def schedule(spark: SparkSession, quotas: list[int]) -> DataFrame:
    """Slots t of the mix: source number and the slot's rank in the source.

    The points give each source its quota but for a few slots: ranks beyond the
    quota are left out, and what is missing follows after the last point.
    """
    total = sum(quotas)
    if not total:
        return spark.createDataFrame([], "t long, _s int, rank long")
    edges = np.array([(int(e) << 64) // total for e in np.cumsum(quotas)[:-1]], dtype=np.uint64)
    n, full = len(quotas), np.array(quotas)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), np.zeros(n, dtype=np.int64)
        for batch in batches:
            t = np.asarray(batch.column(0))
            source = np.searchsorted(edges, t.astype(np.uint64) * GOLDEN, "right")
            order = np.argsort(source, kind="stable")
            counts = np.bincount(source, minlength=n)
            rank = np.empty(len(t), dtype=np.int64)
            firsts = np.cumsum(counts) - counts
            rank[order] = np.arange(len(t)) - np.repeat(firsts, counts)
            rank += held[source]
            held += counts
            yield pa.RecordBatch.from_arrays(
                [pa.array(t), pa.array(source.astype(np.int32)), pa.array(rank), pa.array(np.full(len(t), part))],
                names=["t", "_s", "_rank", "_part"],
            )

    parts = -(-total // RUN)
    drawn = spark.range(0, total, 1, parts).mapInArrow(run, "t long, _s int, _rank long, _part long")
    counts = drawn.groupBy("_s", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_s", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    limits = spark.createDataFrame([(i, int(q)) for i, q in enumerate(full)], "_s int, _quota long")
    limits = F.broadcast(limits)
    ranked = (
        drawn.join(bases, ["_s", "_part"])
        .select("t", "_s", (F.col("_rank") + F.col("_base")).alias("rank"))
        .join(limits, "_s")
        .where(F.col("rank") < F.col("_quota"))
        .drop("_quota")
    )
    missing = (
        counts.groupBy("_s")
        .agg(F.sum("_n").alias("_n"))
        .join(limits, "_s", "right")
        .withColumn("_n", F.coalesce("_n", F.lit(0)))
        .where(F.col("_n") < F.col("_quota"))
        .select("_s", F.explode(F.sequence(F.col("_n"), F.col("_quota") - 1)).alias("rank"))
        .select((F.lit(total) + F.col("rank") * n + F.col("_s")).alias("t"), "_s", "rank")
    )
    return ranked.unionByName(missing)


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, source, size, source_size, target and their place
    in the source) and the mix: slot t, its source number, the document, where
    the taken words begin in it and how many they are.

    ``weights`` repeat over the sources in order of code points, null last.
    The list of sources, one row each, goes through the driver.
    """
    docs = stored(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h"),
        ),
        "mix-sizes",
    )
    found = docs.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [r["n"] for r in found]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, cap)
    quotas = [quota(s, t, block_words) for s, t in zip(sizes, goals)]
    spark = df.sparkSession
    sources = spark.createDataFrame(
        [(i, r["source"], s, g) for i, (r, s, g) in enumerate(zip(found, sizes, goals))],
        "_s int, source string, source_size long, target double",
    )
    docs = docs.join(F.broadcast(sources), docs["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = _laid_out(docs)
    block = F.lit(block_words)
    pieces = placed.where("size > 0").select(
        "_s",
        "doc_id",
        "_at",
        "size",
        F.explode(
            F.sequence((F.col("_at") / block).cast("long"), ((F.col("_at") + F.col("size") - 1) / block).cast("long"))
        ).alias("_block"),
    )
    begin = F.greatest("_at", F.col("_block") * block)
    stop = F.least(F.col("_at") + F.col("size"), (F.col("_block") + 1) * block)
    pieces = pieces.select(
        "_s", "_block", "doc_id", "_at", (begin - F.col("_at")).alias("begin"), (stop - begin).alias("n_words")
    )
    n_blocks = F.element_at(F.array(*[F.lit(-(-s // block_words)) for s in sizes] or [F.lit(1)]), F.col("_s") + 1)
    slots = schedule(spark, quotas).select("t", "_s", F.pmod("rank", n_blocks).alias("_block"))
    return placed, slots.join(pieces, ["_s", "_block"])


def taken_words(df: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and the words the mix takes of each
    document, repeats counted; text_key is xxhash64 of id and text."""
    docs, mixed = mix(df, **options)
    # a place belongs to one document of its source, whatever its id
    taken = mixed.groupBy("_s", "_at").agg(F.sum("n_words").alias("taken"))
    sized = docs.where("size > 0").join(taken, ["_s", "_at"], "left")
    columns = ["doc_id", "size", "source_size", "target"]
    key = F.col("_h").alias("text_key")
    return sized.select(*columns, F.coalesce("taken", F.lit(0)).alias("taken"), key).unionByName(
        docs.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"), key)
    )
