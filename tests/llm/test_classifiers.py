"""Toxicity and ordinal quality on small learnable corpora."""

import math
import random
import zlib

import numpy as np
import pytest

from tokenmill.llm import common, ordinal, toxicity
from samples import frame, words

LABELS = "doc_id long, quality int, toxic int, score string"


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


@pytest.fixture(scope="module")
def corpus(spark):
    """Toxic: two words of a lexicon or of a stem. Poor: marks or one word."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1200):
        text = words(rng, rng.randint(30, 200)).split()
        lang, toxic, poor = rng.choice(["en", "de"]), i % 5 == 0, i % 7 == 3
        for _ in range(2 * toxic):
            bad = rng.choice(["nasty", "vile"]) if lang == "en" else "schurk" + rng.choice(["en", "isch", "ei"])
            text.insert(rng.randint(0, len(text)), bad)
        if poor:
            text = [w + "###" for w in text] if i % 2 else [text[0]] * 60
            toxic = False
        rows.append((i, " ".join(text), lang, "a"))
        labels.append((i, int(not poor), int(toxic), "x"))
    labels += [(None, 1, 1, "x"), (5, 1, None, "x"), (6, None, None, "x"), (7, 1, 0, "x"), (7, 1, 0, "x")]
    return frame(spark, rows).persist(), spark.createDataFrame(labels, LABELS).persist()


def truth(corpus):
    out = {}
    for r in corpus[1].collect():
        if r["doc_id"] is not None and r["toxic"] is not None and r["quality"] is not None:
            out[r["doc_id"]] = (r["quality"], r["toxic"])
    return out


def test_toxicity_on_held_out_rows(corpus):
    known = truth(corpus)
    rows = toxicity.toxicity(*corpus).collect()
    assert len(rows) == 1200
    right = n = 0
    for r in rows:
        assert r["held_out"] == held_out(r["doc_id"])
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        if r["held_out"]:
            n, right = n + 1, right + (r["predicted"] == known[r["doc_id"]][1])
    assert n > 150 and right / n > 0.97


def test_score_comes_from_the_text_alone(spark, corpus):
    model = toxicity.train(*corpus)
    text = "ka lo mi nasty ter vile on"
    rows = [(i, text, lang, s) for i, lang, s in [(1, "en", "a"), (2, "de", "b"), (None, None, None)]]
    assert len({r["score"] for r in toxicity.score(frame(spark, rows), model).collect()}) == 1


def test_fit_does_not_depend_on_partitions(corpus):
    docs, labels = corpus
    one, two = toxicity.train(docs, labels), toxicity.train(docs.repartition(5), labels.repartition(2))
    assert np.array_equal(one.table, two.table) and one.shift == two.shift


def test_odd_rows_have_scores(odd, odd_rows, corpus):
    model = toxicity.train(*corpus)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1


def test_pooling_is_a_plain_maximum(corpus):
    model = toxicity.train(*corpus)
    vectors = toxicity.WordVectors(model)
    texts = ["", "one", "nasty words here and more", "a b"]
    got = toxicity.logits(model, [vectors(t) for t in texts])
    for text, z in zip(texts, got):
        v = np.concatenate([vectors(text), np.zeros((toxicity.PAD, toxicity.DIM), np.float32)])
        tops = []
        for w, f in model.filters.items():
            windows = [sum(v[i + o] @ f[o] for o in range(w)) for i in range(len(v) - toxicity.PAD)]
            tops.append(np.max([*windows, np.zeros(toxicity.FILTERS)], axis=0))
        want = np.maximum(np.concatenate(tops) + model.bias, 0) @ model.weight + model.shift
        assert z == pytest.approx(want, abs=1e-4)


def test_no_labels_and_no_rows(spark, odd, none, corpus):
    nothing = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.toxicity(odd, nothing).collect()} == {0.0}
    assert toxicity.toxicity(none, corpus[1]).collect() == []
    assert {r["expected_grade"] for r in ordinal.graded(odd, nothing).collect()} == {0.0}
    assert ordinal.graded(none, corpus[1]).collect() == []


def test_threshold_in_the_best_gap():
    scores, y = np.array([3.0, 2.0, 2.0, -1.0]), np.array([1, 1, 0, 0])
    assert toxicity.best_threshold(scores, y, np.ones(4)) == pytest.approx(0.5)
    assert toxicity.best_threshold(scores, y, np.array([1, 1, 50, 1.0])) == pytest.approx(2.5)


def test_grades_on_held_out_rows(corpus):
    known = truth(corpus)
    model = ordinal.train(*corpus)
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    rows = ordinal.graded(*corpus).collect()
    held = [r for r in rows if r["held_out"]]
    mean = {g: [] for g in (0, 1, 2)}
    for r in held:
        quality, toxic = known[r["doc_id"]]
        mean[0 if not quality else 2 - toxic].append(r["expected_grade"])
    mean = {g: sum(v) / len(v) for g, v in mean.items()}
    assert mean[0] < mean[1] < mean[2] and mean[0] < 0.4 and mean[2] > 1.6
    good = [r["selected"] == (known[r["doc_id"]] == (1, 0)) for r in held]
    assert sum(good) / len(good) > 0.9


def test_tails_and_expected_grade_agree():
    model = ordinal.Model(np.zeros(1), np.array([-1.0, 2.0]), [0, 1, 2])
    tails = ordinal.tails(model, np.array([-5.0, 0.0, 5.0]))
    assert (np.diff(tails, axis=1) <= 0).all() and (np.diff(tails[:, 1:], axis=0) > 0).all()
    chances = -np.diff(np.c_[tails, np.zeros(3)], axis=1)
    assert chances @ [0, 1, 2] == pytest.approx(tails[:, 1:].sum(axis=1))


def plain_loss(weights, free, batch, y, share):
    """Negative log-likelihood, one text after the other."""
    cuts, loss = [], 0.0
    for i, f in enumerate(free):
        cuts.append(f if not i else cuts[-1] + math.exp(f))
    for features, grade, part in zip(batch, y, share):
        words = [f for f in features if f < 1 << ordinal.BITS]
        latent = sum(weights[f] for f in features if f >= 1 << ordinal.BITS)
        latent += sum(weights[f] for f in words) / math.sqrt(max(1, len(words)))
        at_most = [0.0, *(1 / (1 + math.exp(latent - c)) for c in cuts), 1.0]
        loss -= part * math.log(at_most[grade + 1] - at_most[grade])
    return loss


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(1)
    shapes = np.arange(ordinal.SHAPES) * ordinal.STEPS + (1 << ordinal.BITS)
    batch = [np.concatenate([rng.choice(30, n, replace=False), shapes + n]).astype(np.int32) for n in (1, 4, 9, 6, 2)]
    y, share = np.array([0, 2, 1, 3, 2]), np.array([0.1, 0.3, 0.2, 0.25, 0.15])
    weights = rng.normal(0, 0.5, (1 << ordinal.BITS) + ordinal.SHAPES * ordinal.STEPS)
    free = np.array([-0.4, 0.2, -0.7])
    used, grad, grad_free = ordinal.gradients(weights, free, batch, y, share)
    assert set(used.tolist()) == {int(f) for features in batch for f in features}

    def slope(array, i, step=1e-6):
        ends = []
        for sign in (1, -1):
            moved = array.copy()
            moved[i] += sign * step
            args = (moved, free) if array is weights else (weights, moved)
            ends.append(plain_loss(*args, batch, y, share))
        return (ends[0] - ends[1]) / (2 * step)

    assert grad == pytest.approx([slope(weights, i) for i in used], abs=1e-6)
    assert grad_free == pytest.approx([slope(free, i) for i in range(3)], abs=1e-6)


def test_grades_as_scored_plainly(spark, corpus):
    model = ordinal.train(*corpus)
    texts = ["", "ka lo ka NASTY vile", "### ### ##", "the the the the", "Tertermi, on. 123 ba!"]
    got = {r["doc_id"]: r for r in ordinal.grade_texts(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), model).collect()}
    make = ordinal.Features()
    for i, text in enumerate(texts):
        features = make(text)
        words = [f for f in features if f < 1 << ordinal.BITS]
        latent = sum(model.weights[f] for f in features if f >= 1 << ordinal.BITS)
        latent += sum(model.weights[f] for f in words) / math.sqrt(max(1, len(words)))
        above = [1 / (1 + math.exp(c - latent)) for c in model.thresholds]
        assert got[i]["expected_grade"] == pytest.approx(sum(above))
        assert got[i]["tail_probability"] == pytest.approx(above[1])


def test_ordinal_odd_rows(odd, odd_rows, corpus):
    rows = ordinal.graded(odd, corpus[1]).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["expected_grade"] <= 2 for r in rows)


@pytest.mark.parametrize("name, least", [("op6_toxicity", 0.9), ("op8_ordinal_quality", 0.85)])
def test_queries_on_held_out_rows(spark, name, least):
    from tokenmill.llm import queries

    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    right = []
    for r in rows:
        known = labels.get(r["doc_id"])
        assert r["held_out"] == held_out(r["doc_id"])
        if r["held_out"] and known:
            if name == "op6_toxicity":
                right.append(r["predicted"] == known["toxic"])
            else:
                right.append(r["selected"] == (known["quality"] == 1 and known["toxic"] == 0))
    assert sum(right) / len(right) > least


@pytest.mark.parametrize("module", [toxicity, ordinal])
def test_every_labelled_row_is_learned_from(spark, module, monkeypatch):
    """Each text has a word of its own: the model knows those of all shards."""
    rng = random.Random(5)
    texts = [f"{rng.choice('abcdef')} {rng.choice('ghijkl')}" for _ in range(11_000)]
    texts = [f"{t} only{i}" for i, t in enumerate(texts)]
    learned = [i for i in range(11_000) if not held_out(i)]
    labels = [(i, int(i % 3 > 0), int(i % 3 == 1), "x") for i in learned]
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    seen = []
    whole = common.in_shards

    def watched(*args):
        shards = whole(*args)
        seen.extend(len(r["y"]) // 4 for r in shards.select("y").collect())
        return shards

    monkeypatch.setattr(module, "in_shards", watched)
    monkeypatch.setattr(common, "SHARD_ROWS", 2500)
    model = module.train(docs, spark.createDataFrame(labels, LABELS))
    wanted = [i for i in learned if module is ordinal or zlib.crc32(str(i).encode()) % 5 != toxicity.CALIBRATION_FOLD]
    assert sum(seen) == len(wanted) and len(seen) > 1
    if module is ordinal:
        words = {i: zlib.crc32(f"only{i}".encode()) & ((1 << ordinal.BITS) - 1) for i in wanted}
        assert all(model.weights[w] for w in words.values())
    else:
        start = toxicity.new_model().table
        rows = np.concatenate([toxicity.word_rows(f"only{i}".encode())[:2] for i in wanted])
        assert (model.table[rows] != start[rows]).any(axis=1).mean() > 0.9


def test_shards_follow_from_the_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 700, f"text {i}", i % 2) for i in range(900)] + [(1, None, 0)], "doc_id long, text string, y int")
    monkeypatch.setattr(common, "SHARD_ROWS", 100)

    def pack(texts):
        return ("|".join(texts).encode(),)

    one, two = (
        sorted(map(tuple, common.in_shards(df, 901, 9000, pack, ("texts",)).collect()))
        for df in (rows, rows.repartition(7, "text"))
    )
    assert one == two and len(one) > 5
    assert sum(len(r[2]) // 4 for r in one) == 901 == sum(len(r[3].split(b"|")) for r in one)
    # equal rows, which share a shard, are cut into parts
    equal = spark.createDataFrame([(1, "same", 1)] * 950, "doc_id long, text string, y int")
    parts = sorted((r["part"], len(r["y"]) // 4) for r in common.in_shards(equal, 950, 3800, pack, ("texts",)).collect())
    assert parts == [(0, 200), (1, 200), (2, 200), (3, 200), (4, 150)]
