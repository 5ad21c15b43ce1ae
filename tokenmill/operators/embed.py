"""Token IDs to vectors: lookup, position and type, scale, shift and tanh.

Vector tables in the broadcast bounds are sent as matrices, and rows are worked
on in columns of some thousands. Steps that follow one another are one pass over
the rows: vectors leave a task after the last step only. Tables keep their FLOAT; arithmetic is in
DOUBLE. A word table beyond the bounds is joined by a shuffle, whose partitions
adaptive execution splits where a few tokens make up most rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokenmill.sizes import BROADCAST_BYTES, BROADCAST_ROWS


class Matrix:
    """Rows of a vector table by their number; row 0 stands in for others."""

    def __init__(self, numbers: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(numbers, kind="stable")
        self.numbers, self.rows = numbers[order], rows[order]
        self.zero = self.row(0)

    def places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each number, and whether there is one."""
        at = np.searchsorted(self.numbers, numbers)
        known = at < len(self.numbers)
        known[known] = self.numbers[at[known]] == numbers[known]
        return at, known

    def row(self, number: int) -> np.ndarray | None:
        at, known = self.places(np.array([number]))
        return self.rows[at[0]].astype(np.float64) if known[0] else None

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the numbers, as doubles, and whether there are any: others
        take row 0, which may be missing as well."""
        at, known = self.places(numbers)
        out = self.rows[np.where(known, at, 0)].astype(np.float64)
        if self.zero is not None:
            out[~known] = self.zero
            return out, np.ones(len(numbers), dtype=bool)
        return out, known


def _bounded(df: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """Whether the table of vectors is in the bounds, counted."""
    each = 4 if "float" in df.schema["vec"].dataType.simpleString() else 8
    count, size = df.agg(F.count(F.lit(1)), F.sum(F.size("vec") * each + 16)).first()
    return 0 < count <= max_rows and (size or 0) <= max_bytes


def matrix(
    df: DataFrame, number: str, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> Matrix | None:
    """A table of ``number`` and ``vec`` as a matrix; None beyond the bounds."""
    if not _bounded(df, max_rows, max_bytes):
        return None
    table = df.select(F.col(number).cast("long").alias("number"), "vec").toArrow()
    values = table["vec"].combine_chunks().flatten().to_numpy()
    return Matrix(table["number"].to_numpy(), values.reshape(len(table), -1))


def _lists(vectors: np.ndarray, valid: np.ndarray) -> pa.ListArray:
    """A row of ``vectors`` for each valid row, null for the others."""
    width = vectors.shape[1] if vectors.size else 0
    offsets = np.concatenate([[0], np.cumsum(valid * width)]).astype(np.int32)
    mask = None if valid.all() else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.reshape(-1)), mask=mask)


class Work:
    """Vectors of those rows of a batch that have one (``valid``)."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch = batch
        self.vectors = np.empty((0, 0))
        self.valid = np.zeros(batch.num_rows, dtype=bool)
        self.row_id = None

    def numbers(self, column: str) -> np.ndarray:
        return self.batch.column(column).fill_null(-1).to_numpy().astype(np.int64)

    def keep(self, rows: np.ndarray) -> None:
        """Takes the vectors of the other rows away."""
        both = self.valid & rows
        if not rows[self.valid].all():
            self.vectors = self.vectors[both[self.valid]]
        self.valid = both


Step = Callable[[Work], None]


@dataclass(frozen=True)
class Chain:
    """Rows and the steps that make their vectors, batch by batch. ``needs`` are
    the columns the steps read, ``added`` those they add beside ``vec``."""

    rows: DataFrame
    kept: tuple[str, ...]
    needs: tuple[str, ...]
    added: tuple[str, ...]
    steps: tuple[Step, ...]

    def then(self, step: Step, **more: Column) -> Chain:
        """With one more step, which reads the columns ``more``."""
        return Chain(self.rows.withColumns(more), self.kept, (*self.needs, *more), self.added, (*self.steps, step))

    def frame(self) -> DataFrame:
        """The rows with ``vec``. Further steps on this frame go on with the chain:
        vectors leave the task after the last of them only."""
        kept, added, worked = self.kept, self.added, _worker(self.steps)
        fields = StructType.fromDDL(", ".join([*(f"{c} int" for c in added), "vec array<double>"])).fields
        names = [*kept, *added, "vec"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                work = worked(batch)
                more = [pa.array(work.row_id)] if added else []
                vec = _lists(work.vectors, work.valid)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more, vec], names=names)

        made = self.rows.mapInArrow(run, StructType([*(self.rows.schema[c] for c in kept), *fields]))
        made._chain = self
        return made


def _worker(steps: Sequence[Step]) -> Callable[[pa.RecordBatch], Work]:
    def worked(batch: pa.RecordBatch) -> Work:
        work = Work(batch)
        for step in steps:
            step(work)
        return work

    return worked


def _read(work: Work) -> None:
    column = work.batch.column("vec")
    work.valid = column.is_valid().to_numpy(zero_copy_only=False)
    width = max(1, int(work.valid.sum()))
    work.vectors = column.flatten().to_numpy().astype(np.float64)
    work.vectors = work.vectors.reshape(-1, len(work.vectors) // width)


def _chain(rows: DataFrame) -> Chain:
    """The chain that made these rows, or one that reads their ``vec``."""
    made = rows.__dict__.get("_chain")
    if made is not None:
        return made
    return Chain(rows, tuple(c for c in rows.columns if c != "vec"), ("vec",), (), (_read,))


def _found(words: Matrix) -> Step:
    def step(work: Work) -> None:
        numbers = work.numbers("token_id")
        vectors, work.valid = words.take(numbers)
        work.row_id = np.where(words.places(numbers)[1], numbers, 0).astype(np.int32)
        work.vectors = vectors if work.valid.all() else vectors[work.valid]

    return step


def _added(places: Matrix, column: str) -> Step:
    def step(work: Work) -> None:
        at, known = places.places(work.numbers(column))
        work.keep(known)
        work.vectors += places.rows[at[work.valid]]

    return step


def _scaled(g: np.ndarray, b: np.ndarray | None = None) -> Step:
    def step(work: Work) -> None:
        work.vectors *= g
        if b is not None:
            work.vectors += b

    return step


def _tanh(work: Work) -> None:
    np.tanh(work.vectors, out=work.vectors)


def embedding_lookup(
    tokens: DataFrame,
    word_vec: DataFrame,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Adds ``row_id`` and ``vec`` to rows with ``token_id``.

    IDs without a row in ``word_vec(token_id, vec)`` take row 0.
    """
    words = matrix(word_vec, "token_id", max_rows, max_bytes)
    if words is None:
        return _joined_lookup(tokens, word_vec)
    return Chain(tokens, tuple(tokens.columns), ("token_id",), ("row_id",), (_found(words),)).frame()


def _joined_lookup(tokens: DataFrame, word_vec: DataFrame) -> DataFrame:
    zero = word_vec.filter("token_id = 0").select(F.col("vec").cast("array<double>")).first()
    table = word_vec.select(F.col("token_id").cast("int").alias("token_id"), F.col("vec").alias("_vec"))
    row_zero = F.array(*map(F.lit, zero[0])) if zero else F.lit(None).cast("array<double>")
    return tokens.join(table, "token_id", "left").select(
        *tokens.columns,
        F.when(F.col("_vec").isNotNull(), F.col("token_id")).otherwise(0).alias("row_id"),
        F.coalesce(F.col("_vec").cast("array<double>"), row_zero).alias("vec"),
    )


def place_matrix(
    pos_vec: DataFrame,
    type_vec: DataFrame,
    type_id: int,
    used: DataFrame,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> Matrix:
    """Position and type vector added once for each place. Of a table beyond the
    bounds only the places up to the greatest in ``used`` are taken, at most as
    many as the longest sequence has; they are refused beyond the bounds."""
    kind = type_vec.filter(F.col("type_id") == type_id).select(F.col("vec").cast("array<double>")).first()
    if kind is None:
        raise ValueError(f"no vector of type {type_id}")
    places = matrix(pos_vec, "pos", max_rows, max_bytes)
    if places is None:
        most = used.agg(F.max(used.columns[0])).first()[0] or 0
        places = matrix(pos_vec.filter(F.col("pos").between(0, most)), "pos", max_rows, max_bytes)
    if places is None:
        raise ValueError("a position table is empty or too large to send")
    return Matrix(places.numbers, places.rows.astype(np.float64) + np.array(kind[0]))


def _place(seq_len: Column) -> Column:
    return (F.col("pos") % seq_len).cast("int")


def embedding_sum(
    rows: DataFrame,
    pos_vec: DataFrame,
    type_vec: DataFrame,
    seq_len: Column,
    type_id: int = 0,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Adds the vectors of place ``pos % seq_len`` and of the type. A row without a
    vector, or whose place has none, gives null."""
    chain = _chain(rows)
    used = chain.rows.select(_place(seq_len))
    places = place_matrix(pos_vec, type_vec, type_id, used, max_rows, max_bytes)
    name = f"_at{len(chain.steps)}"
    return chain.then(_added(places, name), **{name: _place(seq_len)}).frame()


def affine_tanh(rows: DataFrame, gamma: Sequence[float], beta: Sequence[float]) -> DataFrame:
    """``tanh(vec * gamma + beta)`` place by place; one factor and one shift
    per dimension."""
    g, b = np.array(gamma, dtype=np.float64), np.array(beta, dtype=np.float64)
    return _chain(rows).then(_scaled(g, b)).then(_tanh).frame()


def bert_embedding(
    tokens: DataFrame,
    word_vec: DataFrame,
    pos_vec: DataFrame,
    type_vec: DataFrame,
    gamma: Sequence[float],
    beta: Sequence[float],
    seq_len: Column,
) -> DataFrame:
    """Vectors of fixed-length token rows ``(…, pos, token_id)``.

    Scale and shift distribute over the sum: they are applied once to each row
    of the position table, so a token is left with one product, one addition and
    the tanh.
    """
    g, b = np.array(gamma, dtype=np.float64), np.array(beta, dtype=np.float64)
    places = place_matrix(pos_vec, type_vec, 0, tokens.select(_place(seq_len)))
    placed = Matrix(places.numbers, places.rows * g + b)
    chain = _chain(embedding_lookup(tokens, word_vec))
    return chain.then(_scaled(g)).then(_added(placed, "_at"), _at=_place(seq_len)).then(_tanh).frame()


def vector_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each key, the sum of all their vectors' values and that of the first
    ones: ``n_vectors``, ``sum_all`` and ``sum_first``.

    Where a chain of steps made the rows, it is run here: each vector is made and
    added up in its task, and a row for each run of equal keys leaves it.
    """
    chain = _chain(rows)
    source = chain.rows.select(*dict.fromkeys([*keys, *chain.needs]))
    worked = _worker(chain.steps)
    names = [*keys, "n_vectors", "sum_all", "sum_first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            work = worked(batch)
            same = np.ones(n - 1, dtype=bool)
            for key in keys:
                column = batch.column(key)
                same &= pc.equal(column[:-1], column[1:]).fill_null(False).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
            none = np.add.reduceat(work.valid.astype(np.int64), starts) == 0
            sums = []
            for own in (work.vectors.sum(axis=1), work.vectors[:, 0] if work.vectors.size else 0.0):
                each = np.zeros(n)
                each[work.valid] = own
                sums.append(pa.array(np.add.reduceat(each, starts), mask=none))
            held = batch.select(list(keys)).take(pa.array(starts))
            counts = pa.array(np.diff(np.append(starts, n)))
            yield pa.RecordBatch.from_arrays([*held.columns, counts, *sums], names=names)

    fields = StructType.fromDDL("n_vectors long, sum_all double, sum_first double").fields
    partial = source.mapInArrow(run, StructType([*(source.schema[k] for k in keys), *fields]))
    return partial.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names[len(keys) :]])
