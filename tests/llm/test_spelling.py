import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from samples import frame, words

from tokenmill.llm import spelling


def plain_words(rows, min_length=5, min_count=3):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def plain_forms(known):
    """Every two words compared."""
    near = defaultdict(list)
    some = sorted(known)
    for i, a in enumerate(some):
        for b in some[i + 1 :]:
            if abs(len(a) - len(b)) <= 1 and distance(a, b) == 1:
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-known[o], o))
        if known[best] >= 2 * known[w]:
            form[w] = best
    rows = set()
    for w, n in known.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n, len(near[w]), known.get(form.get(w))))
    return rows


def got(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def misspelt():
    """Few letters, so that many words are near; some changed by one letter."""
    rng = random.Random(3)
    known = {}
    for _ in range(260):
        w = "".join(rng.choice("abeé") for _ in range(rng.randint(5, 8)))
        known[w] = rng.randint(3, 300)
        i = rng.randrange(len(w))
        for other in (w[:i] + w[i + 1 :], w[:i] + rng.choice("abx") + w[i + 1 :], w[:i] + "z" + w[i:]):
            if len(other) >= 5 and rng.random() < 0.4:
                known.setdefault(other, rng.randint(3, 80))
    return known


@pytest.mark.parametrize(("sample", "leaf"), [(100_000, 4096), (100_000, 8), (40, 16), (1, 4)])
def test_every_near_word(spark, misspelt, sample, leaf):
    table = spark.createDataFrame(list(misspelt.items()), "word string, n long").repartition(3)
    assert got(spelling.word_forms(table, sample, leaf)) == plain_forms(misspelt)


def test_long_words(spark):
    rng = random.Random(5)
    known = {}
    for length in (62, 63, 64, 65, 66, 300, 70_000):
        w = "".join(rng.choice("abcdefgh") for _ in range(length))
        known |= {w: 50, w[:-3] + w[-2:]: 20, "q" + w[1:]: 7, w[:30] + "é" + w[30:]: 3, w[::-1]: 9}
    table = spark.createDataFrame(list(known.items()), "word string, n long").repartition(2)
    rows = got(spelling.word_forms(table, 100, 2))
    near = {w: {v for v in known if v != w and spelling.one_edit(v, w)} for w in known}
    assert {r[0]: r[4] for r in rows} == {w: len(v) for w, v in near.items()}
    assert max(len(v) for v in near.values()) == 3


def test_one_edit():
    rng = random.Random(1)
    some = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    pairs = [(i, j) for i in range(150) for j in range(150) if len(some[i]) <= len(some[j])]
    import numpy as np

    a, b = (np.array(x) for x in zip(*pairs))
    whole = spelling.same_order(some, a, b)
    for (i, j), good in zip(pairs, whole.tolist()):
        assert good == spelling.one_edit(some[i], some[j]) == (distance(some[i], some[j]) == 1)


def test_signatures_and_counts_stay_within_two_steps():
    import numpy as np

    rng = random.Random(2)
    for _ in range(500):
        w = "".join(rng.choice("abcxyzàéÿ") for _ in range(rng.randint(1, 9)))
        i = rng.randrange(len(w))
        v = rng.choice([w[:i] + w[i + 1 :], w[:i] + "ö" + w[i + 1 :], w[:i] + "b" + w[i:]])
        counts = spelling.letter_counts([w, v]).astype(int)
        marks = spelling.signatures(counts.astype(np.uint8))
        assert abs(counts[0] - counts[1]).sum() <= 2 and int(marks[0] ^ marks[1]).bit_count() <= 2


def test_chains_lead_to_the_last_form(spark):
    chain = {"aaaaa" + "b" * i: 3 * 2**i for i in range(20)}
    table = spark.createDataFrame(list(chain.items()), "word string, n long")
    rows = {r["word"]: r["root"] for r in spelling.word_forms(table).collect()}
    assert set(rows.values()) == {"aaaaa" + "b" * 19}


def test_odd_rows(odd, odd_rows):
    assert got(spelling.spelling_variants(odd)) == plain_forms(plain_words(odd_rows))


def test_documents(spark):
    rng = random.Random(11)
    rows = [(i, words(rng, 300).title() if i % 3 else words(rng, 200), "en", "a") for i in range(120)]
    rows += [(1000 + i, "Straße ÉCOLE école Ecole naïveté " * 40, "de", "b") for i in range(3)] * 2
    assert got(spelling.spelling_variants(frame(spark, rows))) == plain_forms(plain_words(rows))


def test_empty_table(none):
    assert spelling.spelling_variants(none).collect() == []
