"""Quality by ordinal regression.

Grades come in steps (0: poor, 1: readable but toxic, 2: good), and a document
has one latent score: the sum of hashed weights of its features. The chance of
a grade of at most k is the logistic curve of threshold k minus the score. The
thresholds are ordered and the weights are shared by all of them, which is the
cumulative-link (proportional-odds) model. It gives the expected grade, and the
chance of a grade at or above a wanted one, by which documents are selected.

Features: the distinct lower-cased words and their beginnings of 4 and 6
characters, each 1 / sqrt(their number), and the shape of the text: shares of
words that are upper case, repeat the word before, end in marks, hold no letter,
in steps of a tenth.

The fit is Adagrad in numpy in the tasks, over all labelled documents, all grades
weighing the same. They are dealt into shards; in each of ``ROUNDS`` rounds every
shard is gone through ``EPOCHS / ROUNDS`` times from the common weights, and each
weight becomes its mean over the shards that moved it. Only these means come to
the driver. Null and empty texts have shape features only. Without
labelled documents of two grades every document has the greatest grade there is
(0 without any) for certain.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import (
    Memo,
    extended,
    fit_round,
    fold,
    in_shards,
    labelled,
    plain_words,
    sub_batches,
    texts_of,
)
from tokenmill.scratch import temporary_tables

BITS = 18
EPOCHS = 20
ROUNDS = 4
BATCH = 32
RATE = 1.0
DECAY = 1e-4
SHAPES = 4
BEGINNINGS = (4, 6)
STEPS = 11


@dataclass
class Model:
    """Weights of the hashed words, then of the shapes; ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]


def shape_steps(text: str) -> list[int]:
    """For each shape the tenths of words that have it, as a feature."""
    words = text.split()
    n = len(words) or 1
    shares = (
        sum(map(str.isupper, words)),
        sum(map(str.__eq__, words, words[1:])),
        sum(not (w[-1].isalnum() or w[-1] in ".,;:?'\")") for w in words),
        sum(not any(map(str.isalpha, w[:1] + w[-1:])) and not any(map(str.isalpha, w)) for w in words),
    )
    return [i * STEPS + 10 * s // n for i, s in enumerate(shares)]


def hashed(word: bytes) -> np.ndarray:
    """Feature numbers of a word and its beginnings."""
    text = word.decode()
    parts = [word, *(b"^" + text[:n].encode() for n in BEGINNINGS if len(text) > n)]
    return np.array([zlib.crc32(p) & ((1 << BITS) - 1) for p in parts], dtype=np.int32)


class Features:
    """Feature numbers of a text: distinct words, then shapes above them."""

    def __init__(self) -> None:
        self.known = Memo(lambda word: hashed(word).tobytes())

    def __call__(self, text: str) -> np.ndarray:
        data = b"".join(map(self.known.__getitem__, set(plain_words(text))))
        words = np.unique(np.frombuffer(data, dtype=np.int32))
        return np.concatenate([words, np.array(shape_steps(text)) + (1 << BITS)]).astype(np.int32)


def scores(weights: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """Latent score of each text."""
    sizes = np.array([len(f) for f in features])
    starts = np.cumsum(sizes) - sizes
    values = np.repeat(1 / np.sqrt(np.maximum(1, sizes - SHAPES)), sizes)
    flat = np.concatenate(features)
    values[flat >= 1 << BITS] = 1.0
    return np.add.reduceat(weights[flat] * values, starts)


def tails(model: Model, latent: np.ndarray) -> np.ndarray:
    """Chance of at least each grade, from the lowest (1)."""
    above = 1 / (1 + np.exp(np.clip(model.thresholds - latent[:, None], -500, 500)))
    return np.concatenate([np.ones((len(latent), 1)), above], axis=1)


def cuts_of(free: np.ndarray) -> np.ndarray:
    """Thresholds: the first, then steps given by their logs, so always in
    order."""
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def gradients(
    weights: np.ndarray, free: np.ndarray, batch: list[np.ndarray], y: np.ndarray, share: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the weighted negative log-likelihood: the features of the batch and
    the gradient of each, and that of ``free``."""
    latent = scores(weights, batch)
    edges = np.concatenate([[-np.inf], cuts_of(free), [np.inf]])
    high = 1 / (1 + np.exp(-np.clip(edges[y + 1] - latent, -500, 500)))
    low = 1 / (1 + np.exp(-np.clip(edges[y] - latent, -500, 500)))
    inside = np.maximum(high - low, 1e-9)
    # d log(high - low) by the upper edge, by the lower and by the score
    up, down = high * (1 - high) / inside, low * (1 - low) / inside
    back = share * (up - down)
    sizes = np.array([len(f) for f in batch])
    flat = np.concatenate(batch)
    values = np.repeat(back / np.sqrt(np.maximum(1, sizes - SHAPES)), sizes)
    values = np.where(flat >= 1 << BITS, np.repeat(back, sizes), values)
    used, which = np.unique(flat, return_inverse=True)
    by_cut = np.array([(share * (down * (y == i + 1) - up * (y == i))).sum() for i in range(len(free))])
    after = by_cut[::-1].cumsum()[::-1]  # a step moves all cuts above it
    return used, np.bincount(which, values), after * np.concatenate([[1.0], np.exp(free[1:])])


def packed_features(texts: list[str]) -> tuple[bytes, bytes]:
    """Number of features of each text, and the features."""
    make = Features()
    found = [make(t) for t in texts]
    return np.array([len(f) for f in found], np.int32).tobytes(), b"".join(f.tobytes() for f in found)


def epoch(
    weights: np.ndarray, square: np.ndarray, free: np.ndarray, free_square: np.ndarray,
    features: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rng: np.random.Generator,
) -> None:
    """Adagrad on small batches, each document once."""
    order = rng.permutation(len(y))
    for at in range(0, len(y), BATCH):
        some = order[at : at + BATCH]
        used, grad, grad_free = gradients(weights, free, [features[i] for i in some], y[some], weight[some] / len(some))
        grad += DECAY * weights[used]
        square[used] += grad**2
        weights[used] -= RATE * grad / np.sqrt(square[used])
        free_square += grad_free**2
        free -= RATE * grad_free / np.sqrt(free_square)


def fit(shards: DataFrame, drawn: list[int], grades: list[int], seed: int = 42) -> Model:
    """Rounds over shards of packed features; ``drawn`` documents of each grade
    are in them. Weights and thresholds are the means over the second half of the
    epochs, which single batches move little."""
    size = (1 << BITS) + SHAPES * STEPS
    present = np.array(drawn) > 0
    by_grade = sum(drawn) / present.sum() / np.maximum(1, drawn)
    below = np.clip(np.cumsum(present)[:-1] / present.sum(), 1e-3, 1 - 1e-3)
    cuts = np.log(below / (1 - below))
    free = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    start = np.concatenate([np.zeros(size), free])
    squares = np.concatenate([np.full(size, 1e-4), np.full(len(free), 1e-2)])
    state, means = [start[:, None], squares[:, None]], []
    for number in range(ROUNDS):

        def learn(arrays: list[np.ndarray], row: dict) -> list[np.ndarray]:
            values, square = (x[:, 0] for x in arrays)
            y = np.frombuffer(row["y"], np.int32)
            ends = np.cumsum(np.frombuffer(row["sizes"], np.int32), dtype=np.int64)
            features = np.split(np.frombuffer(row["features"], np.int32), ends[:-1])
            rng = np.random.default_rng([seed, number, row["shard"], row["part"]])
            total, epochs = np.zeros_like(values), EPOCHS // ROUNDS
            for _ in range(epochs):
                epoch(values[:size], square[:size], values[size:], square[size:], features, y, by_grade[y], rng)
                total += values
            return [values[:, None], square[:, None], total[:, None] / epochs]

        *state, mean = fit_round(shards, state, learn, more=1)
        if number >= ROUNDS // 2:
            means.append(mean[:, 0])
    mean = np.mean(means, axis=0)
    return Model(mean[:size], cuts_of(mean[size:]), grades)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Model of the labels outside fold 0."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 1).when(
        F.col("quality") == 1, 2
    )
    rated = labels.select(F.col(id_col).alias("doc_id"), "quality", "toxic")
    rows, ids = labelled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rated, grade)
    grades = sorted(r["y"] for r in ids.select("y").distinct().collect())
    sizes = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n_bytes"))
    sizes = {r["y"]: (r["n"], r["n_bytes"]) for r in sizes.collect()}
    if len(sizes) < 2:
        return Model(np.zeros((1 << BITS) + SHAPES * STEPS), np.zeros(0), grades[-1:] or [0])
    drawn = [sizes.get(g, (0, 0))[0] for g in grades]
    place = F.array_position(F.array(*map(F.lit, grades)), F.col("y")) - 1
    with temporary_tables(docs.sparkSession):
        shards = in_shards(
            rows.withColumn("y", place.cast("int")),
            sum(drawn),
            sum(size for _, size in sizes.values()),
            packed_features,
            ("sizes", "features"),
        )
        return fit(shards, drawn, grades)


def grade_texts(
    df: DataFrame, model: Model, min_grade: int = 2, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep``, expected_grade and tail_probability: the chance of
    ``min_grade`` or better."""
    rows = df.select(*keep, df[text_col].alias("_text"))
    steps = np.diff(np.array(model.grades, dtype=float))
    wanted = int(np.searchsorted(model.grades, min_grade))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in sub_batches(batches, "_text"):
            latent = scores(model.weights, [make(x) for x in texts_of(batch.column("_text"))])
            chance = tails(model, latent)
            expected = model.grades[0] + chance[:, 1:] @ steps
            tail = chance[:, wanted] if wanted < len(model.grades) else np.zeros(len(latent))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(expected), pa.array(np.ascontiguousarray(tail))],
                names=[*keep, "expected_grade", "tail_probability"],
            )

    return rows.mapInArrow(run, extended(df, keep, "expected_grade double, tail_probability double"))


def graded(docs: DataFrame, labels: DataFrame, min_grade: int = 2, **options) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability and selected (the
    chance of ``min_grade`` or better is at least one half)."""
    return grade_texts(docs, train(docs, labels, **options), min_grade).select(
        "doc_id",
        (fold() == 0).alias("held_out"),
        "expected_grade",
        "tail_probability",
        (F.col("tail_probability") >= 0.5).alias("selected"),
    )
