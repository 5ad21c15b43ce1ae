"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokenmill.scratch import stored
from tokenmill.sizes import broadcast_if_small

#: White space of the word contracts: blank and the controls 9 to 13. It is
#: also what ``bytes.split()`` splits at.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of the labels whose remainder is 0 are held out of every fit.
FOLDS = 5


ROOT = str(Path(__file__).resolve().parents[2])


#: Rows of whole texts that go to a worker at once; Spark's own number is 10,000.
ARROW_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Sends texts in batches of ARROW_ROWS rows, unless the session has a
    number of its own: buffers of both sides grow with the texts of a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ARROW_ROWS))


def give_back() -> None:
    """Returns free memory to the system. Workers live on from stage to stage,
    and what their allocators keep adds up beside the heap of the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, giving its memory back at the end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Workers that start later find this package where the
    driver has it; on a cluster without shared folders use ``--py-files``."""
    short_batches(spark)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(df: DataFrame, keep: Iterable[str], added: str) -> StructType:
    """Schema of the kept columns and the added ones."""
    return StructType([*(df.schema[c] for c in keep), *StructType.fromDDL(added)])


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS


def texts_of(column: pa.Array) -> list[str]:
    """Values of a string column, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def sub_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of ``column`` come to about ``limit``
    bytes each; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop


def list_array(values: np.ndarray, lengths: Iterable[int]) -> pa.ListArray:
    """Arrow lists over consecutive runs of ``values``."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


class Memo(dict):
    """Values by key, made when first asked for.

    Two generations: when the young one is full it becomes the old one, and
    what is asked for again moves back. So at most ``2 * limit`` values are
    held, and frequent keys stay.
    """

    def __init__(self, make, limit: int = 100_000, longest: int = 64) -> None:
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key: str):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def labelled(docs: DataFrame, labels: DataFrame, label: Column, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """All documents that have a label outside fold 0, with ``y`` and ``fold``,
    and the labelled ids.

    An id with several labels has its greatest, an id or label that is null is
    left out."""
    ids = labels.select(F.col(id_col).alias("_id"), label.cast("int").alias("y"))
    ids = ids.where(F.col("_id").isNotNull() & F.col("y").isNotNull() & (fold("_id") != 0))
    ids = ids.groupBy("_id").agg(F.max("y").alias("y")).withColumn("fold", fold("_id"))
    sent = broadcast_if_small(ids, F.lit(24))
    return docs.join(sent, docs[id_col] == sent["_id"]).drop("_id"), ids


#: Documents and bytes of text that are learned from at once, on average.
SHARD_ROWS = 8000
SHARD_BYTES = 32 << 20


def in_shards(
    rows: DataFrame, n: int, n_bytes: int, pack: Callable[[list[str]], tuple[bytes, ...]], names: tuple[str, ...]
) -> DataFrame:
    """``rows`` (doc_id, text, y; ``n`` of them with ``n_bytes`` of text) dealt by
    hash into shards, one stored row for each: ``shard``, ``part``, ``y`` and what
    ``pack`` makes of its texts, as binary ``names``.

    Which rows share a shard, and their order, follow from the rows alone. A
    shard of more than twice the average size is cut into parts."""
    count = max(1, -(-n // SHARD_ROWS), -(-n_bytes // SHARD_BYTES))
    keyed = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y").withColumn("_h", F.xxhash64("doc_id", "text"))
    keyed = keyed.withColumn("shard", F.pmod("_h", F.lit(count)).cast("int"))
    dealt = keyed.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "doc_id", "_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, texts, y, size = None, 0, [], [], 0

        def done() -> pa.RecordBatch:
            columns = [pa.array([at], pa.int32()), pa.array([part], pa.int32())]
            columns += [pa.array([x], pa.binary()) for x in (np.array(y, np.int32).tobytes(), *pack(texts))]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "part", "y", *names])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "text", "y"))
            for shard, text, label in zip(*columns):
                full = len(y) >= 2 * SHARD_ROWS or size >= 2 * SHARD_BYTES
                if y and (full or shard != at):
                    yield done()
                    part = part + 1 if shard == at else 0
                    texts, y, size = [], [], 0
                at = shard
                texts.append(text)
                y.append(label)
                size += len(text)
        if y:
            yield done()

    schema = ", ".join(["shard int", "part int", "y binary", *(f"{c} binary" for c in names)])
    return stored(dealt.select("shard", "text", "y").mapInArrow(frugal(run), schema), "fit-shards")


def exact(values: np.ndarray) -> np.ndarray:
    """Rounded to multiples of 2 ** -24, so that sums do not depend on the order."""
    return (np.rint(values.astype(np.float64) * (1 << 24)) / (1 << 24)).astype(np.float32)


def fit_round(
    shards: DataFrame, state: list[np.ndarray], learn: Callable[[list[np.ndarray], dict], list[np.ndarray]], more: int = 0
) -> list[np.ndarray]:
    """State after each shard learned from ``state`` on its own: every row of the
    state is the mean over the shards that moved it.

    ``learn`` gets copies of the arrays (rows by columns) and the row of a shard,
    and returns arrays of that shape, ``more`` of them than it gets; where no
    shard moved them those are like the first."""
    width = state[0].shape[1]
    frozen = [x.copy() for x in state]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                after = learn([x.copy() for x in frozen], row)
                moved = np.flatnonzero(np.any([(x != y).any(axis=1) for x, y in zip(after, frozen)], axis=0))
                parts = [exact(x[moved]) for x in after]
                columns = [np.ascontiguousarray(x[:, k]) for x in parts for k in range(width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(moved.astype(np.int32)), *map(pa.array, columns)],
                    names=["place", *(f"v{k}" for k in range(len(columns)))],
                )

    names = [f"v{k}" for k in range((len(frozen) + more) * width)]
    schema = ", ".join(["place int", *(f"{c} float" for c in names)])
    means = shards.mapInArrow(frugal(run), schema).groupBy("place").agg(*(F.avg(c).alias(c) for c in names))
    found = means.toArrow()
    new = [x.copy() for x in [*frozen, *frozen[:1] * more]]
    places = found["place"].to_numpy()
    for k, name in enumerate(names):
        new[k // width][places, k % width] = found[name].to_numpy()
    return new


#: ASCII that is neither letter nor digit separates the words of classifiers.
SEPARATED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: str) -> list[bytes]:
    """Lower-cased words without marks."""
    return text.lower().encode().translate(SEPARATED).split()
