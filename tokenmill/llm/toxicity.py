"""Toxicity by a convolutional classifier on hashed words.

A word's vector is the sum of rows of one table, found by hashes: two of the
whole word (words which share one row seldom share both), one of its end and
one of each of its beginnings of 3 to 7 characters, so that unseen forms of a
stem are known. Filters of the widths 1, 2 and 3 run over the vectors of a whole
text, each keeps its greatest response, and a logistic layer reads those.

It is fitted with numpy in the tasks, on all labelled documents. They are dealt
into shards; in each of ``EPOCHS`` rounds every shard is gone through once from
the common model, and the models are averaged, each row of the table over the
shards that moved it. Only these means come to the driver.

One of the learning folds is kept back to place the scale: the score 0.5 lies
where F1 on all its rows is best, counted in steps of ``1 / STEP`` of the scale,
and each language with enough toxic examples gets a threshold of its own. The
language decides the threshold of ``rejected`` only; nothing but the text enters
the score.

Null and empty texts have no words: all filters give their response to nothing,
which is a score like others. Without labels of both classes there is nothing
to learn, and every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import (
    Memo,
    extended,
    fit_round,
    fold,
    frugal,
    in_shards,
    labelled,
    plain_words,
    sub_batches,
    texts_of,
)
from tokenmill.scratch import temporary_tables

ROWS = 1 << 17
BEGINNINGS = (3, 4, 5, 6, 7)
PER_WORD = 3 + len(BEGINNINGS)
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
EPOCHS = 4
BATCH = 32
RATE = 0.1
#: Toxic examples a language needs for a threshold of its own.
PER_LANGUAGE = 30
CALIBRATION_FOLD = 1
#: Counts behind thresholds are taken in steps of the scale, this many a unit.
STEP = 1024


@dataclass
class Model:
    """Table, filters and scale; ``thresholds`` by language, as scores."""

    table: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    shift: float
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)


def new_model(seed: int = 42) -> Model:
    rng = np.random.default_rng(seed)
    table = np.concatenate([rng.normal(0, 0.03, (ROWS, DIM)), np.zeros((1, DIM))]).astype(np.float32)
    filters = {w: rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    n = FILTERS * len(WIDTHS)
    return Model(table, filters, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), 0.0)


def word_rows(word: bytes) -> np.ndarray:
    """Rows of a word; ROWS where it has no such part."""
    text = word.decode()
    whole = zlib.crc32(word)
    parts = [whole % ROWS, (whole >> 15) % ROWS, zlib.crc32(text[-4:].encode(), 1) % ROWS if len(text) > 4 else ROWS]
    parts += [zlib.crc32(text[:n].encode(), 2) % ROWS if len(text) > n else ROWS for n in BEGINNINGS]
    return np.array(parts, dtype=np.int32)


def laid_out(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text begins when PAD empty words follow each text, which
    places are empty, and the places of the words."""
    padded = np.array(sizes) + PAD
    ends = np.cumsum(padded)
    empty = np.zeros(ends[-1], dtype=bool)
    for back in range(1, PAD + 1):
        empty[ends - back] = True
    return ends - padded, empty, np.flatnonzero(~empty)


def responses(model: Model, vectors: np.ndarray, empty: np.ndarray) -> dict[int, np.ndarray]:
    """Response of each filter at each word; windows of padding give 0."""
    out = {}
    for w, weights in model.filters.items():
        z = vectors @ weights[0]
        for o in range(1, w):
            z[:-o] += vectors[o:] @ weights[o]
        z[empty] = 0
        out[w] = z
    return out


def logits(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Scores before the logistic curve, of texts given as word vectors."""
    starts, empty, places = laid_out([len(t) for t in texts])
    vectors = np.zeros((len(empty), DIM), dtype=np.float32)
    vectors[places] = np.concatenate(texts)
    maps = responses(model, vectors, empty)
    tops = np.concatenate([np.maximum.reduceat(z, starts, axis=0) for z in maps.values()], axis=1)
    return np.maximum(tops + model.bias, 0) @ model.weight + model.shift


class WordVectors:
    """Vectors of the words of a text."""

    def __init__(self, model: Model) -> None:
        table = model.table
        self.known = Memo(lambda word: table[word_rows(word)].sum(axis=0).tobytes())

    def __call__(self, text: str) -> np.ndarray:
        data = b"".join(map(self.known.__getitem__, plain_words(text)))
        return np.frombuffer(data, dtype=np.float32).reshape(-1, DIM)


def packed_texts(texts: list[str]) -> tuple[bytes, bytes, bytes]:
    """Number of words of each text, the words by their place among the different
    ones, and the rows of those, PER_WORD for each."""
    known: dict[bytes, int] = {}
    words = [[known.setdefault(w, len(known)) for w in plain_words(t)] for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int32)
    flat = np.fromiter((w for text in words for w in text), dtype=np.int32, count=int(sizes.sum()))
    return sizes.tobytes(), flat.tobytes(), b"".join(word_rows(w).tobytes() for w in known)


class PackedTexts:
    """Rows of the words of texts that :func:`packed_texts` packed."""

    def __init__(self, sizes: bytes, words: bytes, rows: bytes) -> None:
        self.ends = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64)])
        self.words = np.frombuffer(words, np.int32)
        self.rows = np.frombuffer(rows, np.int32).reshape(-1, PER_WORD)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.rows[self.words[self.ends[i] : self.ends[i + 1]]]


def packed(model: Model) -> np.ndarray:
    """All numbers of a model in rows of DIM, the table's first."""
    flat = np.concatenate([*(f.ravel() for f in model.filters.values()), model.bias, model.weight, [model.shift]])
    flat = np.concatenate([flat, np.zeros(-len(flat) % DIM)]).astype(np.float32)
    return np.concatenate([model.table, flat.reshape(-1, DIM)])


def unpacked(values: np.ndarray) -> Model:
    table, flat = values[: ROWS + 1].copy(), values[ROWS + 1 :].ravel()
    filters, at = {}, 0
    for w in WIDTHS:
        size = w * DIM * FILTERS
        filters[w] = flat[at : at + size].reshape(w, DIM, FILTERS).copy()
        at += size
    n = FILTERS * len(WIDTHS)
    return Model(table, filters, flat[at : at + n].copy(), flat[at + n : at + 2 * n].copy(), float(flat[at + 2 * n]))


def new_squares(model: Model) -> Model:
    """Where the sums of squared gradients begin."""
    small = {w: np.full_like(f, 1e-3) for w, f in model.filters.items()}
    return Model(
        np.full_like(model.table, 1e-3), small, np.full_like(model.bias, 1e-3), np.full_like(model.weight, 1e-3), 1e-3
    )


def epoch(
    model: Model, squares: Model, texts: PackedTexts, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator
) -> None:
    """Adagrad on small batches of texts, each once; words are dropped at random
    so that no single one is relied on."""
    order = rng.permutation(len(y))
    for at in range(0, len(y), BATCH):
        some = order[at : at + BATCH]
        batch = [t[rng.random(len(t)) > 0.1] for t in (texts[i] for i in some)]
        starts, empty, places = laid_out([len(t) for t in batch])
        rows = np.full((len(empty), PER_WORD), ROWS, dtype=np.int32)
        rows[places] = np.concatenate(batch)
        vectors = model.table[rows].sum(axis=1)
        maps = responses(model, vectors, empty)
        ends = np.append(starts[1:], len(rows))
        best = {w: np.stack([a + z[a:b].argmax(axis=0) for a, b in zip(starts, ends)]) for w, z in maps.items()}
        tops = np.concatenate([np.take_along_axis(z, best[w], 0) for w, z in maps.items()], axis=1)
        active = np.maximum(tops + model.bias, 0)
        p = 1 / (1 + np.exp(-(active @ model.weight + model.shift)))
        error = ((p - y[some]) * weight[some] / len(some)).astype(np.float32)
        back = error[:, None] * model.weight * (active > 0)
        grads = {"bias": back.sum(0), "weight": error @ active, "shift": error.sum()}
        wheres, parts = [], []
        for i, (w, filters) in enumerate(model.filters.items()):
            # a window of padding has no words to learn from
            mine = back[:, i * FILTERS : (i + 1) * FILTERS] * ~empty[best[w]]
            grad = np.zeros_like(filters)
            for o in range(w):
                where = np.minimum(best[w] + o, len(rows) - 1)
                grad[o] = np.einsum("nfd,nf->df", vectors[where], mine)
                wheres.append(where.ravel())
                parts.append((mine[:, :, None] * filters[o].T).reshape(-1, DIM))
            squares.filters[w] += grad**2
            filters -= RATE * grad / np.sqrt(squares.filters[w])
        used, which = np.unique(rows[np.concatenate(wheres)].ravel(), return_inverse=True)
        grad = np.zeros((len(used), DIM), np.float32)
        np.add.at(grad, which, np.repeat(np.concatenate(parts), PER_WORD, axis=0))
        grad[used == ROWS] = 0  # padding stays empty
        squares.table[used] += grad**2
        model.table[used] -= RATE * grad / np.sqrt(squares.table[used])
        for name, grad in grads.items():
            square = getattr(squares, name) + grad**2
            setattr(squares, name, square)
            setattr(model, name, getattr(model, name) - RATE * grad / np.sqrt(square))


def fit(shards: DataFrame, weights: tuple[float, float], seed: int = 42) -> Model:
    """Rounds over shards of packed texts; ``weights`` are those of the classes."""
    model = new_model(seed)
    state = [packed(model), packed(new_squares(model))]
    by_class = np.array(weights, dtype=np.float32)
    for number in range(EPOCHS):

        def learn(arrays: list[np.ndarray], row: dict) -> list[np.ndarray]:
            mine, squares = map(unpacked, arrays)
            y = np.frombuffer(row["y"], np.int32)
            rng = np.random.default_rng([seed, number, row["shard"], row["part"]])
            texts = PackedTexts(row["sizes"], row["words"], row["rows"])
            epoch(mine, squares, texts, y.astype(np.float32), by_class[y], rng)
            return [packed(mine), packed(squares)]

        state = fit_round(shards, state, learn)
    return unpacked(state[0])


def best_threshold(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Middle of the gap at which F1 is best."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(weight[order] * y[order])
    taken = np.cumsum(weight[order])
    f1 = 2 * hits / (taken + (weight * y).sum())
    ordered = scores[order]
    f1[:-1][ordered[:-1] == ordered[1:]] = -1  # equal scores go together
    at = int(f1.argmax())
    below = ordered[at + 1] if at + 1 < len(ordered) else ordered[at] - 1
    return float((ordered[at] + below) / 2)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "toxic",
) -> Model:
    """Model of the labels outside fold 0."""
    rows, ids = labelled(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
        ),
        labels.select(F.col(id_col).alias("doc_id"), label_col),
        (F.col(label_col) == 1).cast("int"),
    )
    held = F.col("fold") == CALIBRATION_FOLD
    sizes = rows.groupBy("y", held.alias("held")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n_bytes")
    )
    sizes = {(r["y"], r["held"]): (r["n"], r["n_bytes"]) for r in sizes.collect()}
    if {y for y, _ in sizes} != {0, 1}:
        model = new_model()
        model.constant = float(ids.agg(F.coalesce(F.avg("y"), F.lit(0.0))).first()[0])
        return model
    learned = rows
    if len(sizes) == 4:  # both parts have both classes
        learned, rows = rows.where(~held), rows.where(held)
        sizes = {k: v for k, v in sizes.items() if not k[1]}
    of_class = [sum(n for (y, _), (n, _) in sizes.items() if y == c) for c in (0, 1)]
    n = sum(of_class)
    with temporary_tables(docs.sparkSession):
        shards = in_shards(
            learned, n, sum(size for _, size in sizes.values()), packed_texts, ("sizes", "words", "rows")
        )
        model = fit(shards, (n / 2 / of_class[0], n / 2 / of_class[1]))
    place_scale(model, rows)
    return model


def place_scale(model: Model, rows: DataFrame) -> None:
    """Shift and thresholds by F1 on ``rows`` (text, lang, y). They come to the
    driver as counts of each language, class and step of the scale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = WordVectors(model)
        for batch in sub_batches(batches, "text", 1 << 20):
            z = logits(model, [vectors(x) for x in texts_of(batch.column("text"))])
            at = pa.array(np.floor(z.astype(np.float64) * STEP).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("y"), at], names=["lang", "y", "at"])

    steps = rows.select("text", "lang", "y").mapInArrow(frugal(run), "lang string, y int, at long")
    found = steps.groupBy("lang", "y", "at").count().toArrow()
    langs = np.array([x or "" for x in found["lang"].to_pylist()], dtype=object)
    y, n = found["y"].to_numpy().astype(float), found["count"].to_numpy().astype(float)
    scores = (found["at"].to_numpy() + 0.5) / STEP
    shift = best_threshold(scores, y, n)
    model.shift -= shift
    for lang in sorted(set(langs)):
        mine = langs == lang
        if lang and (y * n)[mine].sum() >= PER_LANGUAGE:
            cut = best_threshold(scores[mine] - shift, y[mine], n[mine])
            model.thresholds[lang] = float(1 / (1 + np.exp(-cut)))


def score(
    df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep``, score, threshold (the language's) and rejected."""
    text = text_col if text_col in keep else "_text"  # sent once
    rows = df.select(*keep, *([] if text in keep else [df[text_col].alias(text)]), df[lang_col].cast("string").alias("_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = WordVectors(model)
        for batch in sub_batches(batches, text, 1 << 20):
            if model.constant is None:
                z = logits(model, [vectors(x) for x in texts_of(batch.column(text))])
                scores = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -500, 500)))
            else:
                scores = np.full(batch.num_rows, float(model.constant))
            cuts = np.array([model.thresholds.get(x, 0.5) for x in batch.column("_lang").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(scores), pa.array(cuts), pa.array(scores >= cuts)],
                names=[*keep, "score", "threshold", "rejected"],
            )

    return rows.mapInArrow(frugal(run), extended(df, keep, "score double, threshold double, rejected boolean"))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold and rejected."""
    return score(docs, train(docs, labels, **options)).select(
        "doc_id",
        (fold() == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        "rejected",
    )
