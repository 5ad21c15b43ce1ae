import random
from collections import Counter

import numpy as np
import pytest

from tokenmill.llm import ordermin
from tokenmill.llm.components import components
from samples import frame, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, share):
    out = text.split()
    for _ in range(int(share * len(out))):
        i, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[i] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            out.insert(i, f"more{rng.randrange(10**6)}")
        else:
            del out[i]
    return " ".join(out)


def union(pairs, ids):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(4000):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        b = a[:] if rng.random() < 0.5 else [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.choice("abcde"))
            if rng.random() < 0.5:
                del b[rng.randrange(len(b))]
        most = rng.randint(0, 8)
        assert ordermin.banded_distance(a, b, most) == min(distance(a, b), most + 1)


def test_alike_at_the_border():
    a = [str(i).encode() for i in range(100)]
    assert ordermin.alike(a, [b"x"] * 20 + a[20:])
    assert not ordermin.alike(a, [b"x"] * 21 + a[21:])


def test_sketch_keeps_order_and_labels():
    a, b = [w.encode() for w in words(random.Random(1), 60).split()], [w.encode() for w in words(random.Random(2), 60).split()]
    assert (ordermin.sketch(a + b) == ordermin.sketch(a + b)).all()
    same = (ordermin.sketch(a + b) == ordermin.sketch(b + a)).mean()
    assert same < 0.8  # the same runs but for the seams, in other order
    runs, labelled = ordermin.labelled_runs([b"a"] * 9)
    assert len(set(runs.tolist())) == 1 and len(set(labelled.tolist())) == 5


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows, passage = [], words(rng, 60)
    for i in range(120):
        rows.append((i, words(rng, rng.randint(60, 160)), "en", "a"))
    for i in range(40):  # near copies, copies, near copies of near copies
        rows.append((200 + i, edited(rng, rows[i % 15][1], 0.06), "en", "a"))
        rows.append((300 + i, rows[i][1], "en", "a"))
    for i in range(30):  # unrelated texts that share a passage
        rows.append((400 + i, f"{words(rng, 90)} {passage} {words(rng, 90)}", "en", "a"))
    hot = words(rng, 120)
    rows += [(500 + i, edited(rng, hot, 0.05), "en", "a") for i in range(50)]
    return rows


def brute(rows):
    texts = {i: t.encode().split() for i, t, *_ in rows}
    ids, pairs = sorted(texts), []
    for n, a in enumerate(ids):
        count = Counter(texts[a])
        for b in ids[:n]:
            longer = max(len(texts[a]), len(texts[b]))
            if (count & Counter(texts[b])).total() >= 0.8 * longer and distance(texts[a], texts[b]) <= 0.2 * longer:
                pairs.append((a, b))
    return union(pairs, ids)


@pytest.fixture(scope="module")
def want(corpus):
    return brute(corpus)


def test_classes_against_all_pairs(spark, corpus, want):
    got = {r["doc_id"]: r["class_id"] for r in ordermin.classes(frame(spark, corpus)).collect()}
    assert got == want


def test_one_of_each_class_stays(spark, corpus, want):
    df = frame(spark, corpus)
    kept = ordermin.first_of_class(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_odd_rows(odd, odd_rows):
    rows = ordermin.classes(odd).collect()
    assert len(rows) == len(odd_rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert by[1] == by[2] == {1}  # null and empty are the same text
    assert by[8] == {8} and by[9] == {9}  # one id is one document
    assert by[None] == {None}
    kept = ordermin.first_of_class(odd).collect()
    ids = [r["doc_id"] for r in kept]
    assert len(ids) == len(set(ids)) and None in ids and 2 not in ids


def test_null_id_joins_its_copies(spark):
    text = words(random.Random(8), 50)
    rows = [(None, text, "en", "a"), (4, text, "en", "a"), (3, edited(random.Random(1), text, 0.04), "en", "a")]
    got = {r["doc_id"]: r["class_id"] for r in ordermin.classes(frame(spark, rows)).collect()}
    assert got == {None: 3, 4: 3, 3: 3}


def test_rows_without_or_with_one_id_are_texts_of_their_own(spark):
    rng = random.Random(11)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(4, a, "en", "a"), (None, a, "en", "a"), (5, b, "en", "a"), (None, b, "en", "a")]
    rows += [(None, c, "en", "a"), (None, d, "en", "a"), (7, a + " x", "en", "a"), (7, d + " y", "en", "a")]
    got = ordermin.classes(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"] or 0), r["class_id"] or 0) for r in got) == [
        (0, 0), (0, 4), (0, 5), (0, 7), (4, 4), (5, 5), (7, 4), (7, 7)
    ]
    for one_per_id in (True, False):
        kept = ordermin.first_of_class(frame(spark, rows), one_per_id=one_per_id).collect()
        assert sorted(r["text"] for r in kept) == sorted([a, b, c, d + " y"])
    again = [(8, a, "en", "a"), (8, b, "en", "a"), (8, b, "en", "a")]
    kept = ordermin.first_of_class(frame(spark, again), one_per_id=False).collect()
    assert sorted(r["text"] for r in kept) == sorted([a, b])


def with_passage(rng, groups):
    """Pairs of like texts, most of whose words are a passage shared by all."""
    passage, rows = words(rng, 150), []
    for i in range(groups):
        text = f"{words(rng, 30)} {passage} {words(rng, 30)}"
        rows += [(2 * i, text, "en", "a"), (2 * i + 1, edited(rng, text, 0.1), "en", "a")]
    return rows


def test_like_texts_whose_groups_have_another_least_node(spark, monkeypatch):
    rows = with_passage(random.Random(12), 40)
    monkeypatch.setattr(ordermin, "BLOCK", 16)  # several blocks
    got = {r["doc_id"]: r["class_id"] for r in ordermin.classes(frame(spark, rows)).collect()}
    # every pair that shares a sketch is compared
    texts = {i: t.encode().split() for i, t, *_ in rows}
    keys = {i: set(ordermin.sketch(t).tolist()) for i, t in texts.items()}
    like = [(a, b) for a in texts for b in texts if a < b and keys[a] & keys[b] and ordermin.alike(texts[a], texts[b])]
    assert len(like) >= 35 and got == union(like, sorted(texts))


def test_large_classes_meet_the_others_of_their_groups(spark, monkeypatch):
    """Families of near copies around one passage, larger than a block, beside
    small classes that share their groups and may join them."""
    rng = random.Random(21)
    passage, rows = words(rng, 150), []
    for _ in range(3):
        text = f"{words(rng, 28)} {passage} {words(rng, 28)}"
        rows += [edited(rng, text, 0.03) for _ in range(26)] + [edited(rng, text, 0.16) for _ in range(6)]
    rows += [f"{words(rng, 28)} {passage} {words(rng, 28)}" for _ in range(12)]
    rng.shuffle(rows)
    rows = [(i, t, "en", "a") for i, t in enumerate(rows)]
    texts = {i: t.encode().split() for i, t, *_ in rows}
    keys = {i: set(ordermin.sketch(t).tolist()) for i, t in texts.items()}
    like = [(a, b) for a in texts for b in texts if a < b and keys[a] & keys[b] and ordermin.alike(texts[a], texts[b])]
    want = union(like, sorted(texts))
    assert max(Counter(want.values()).values()) > 20 and len(set(want.values())) > 5
    for block in (8, 16, 1024):
        monkeypatch.setattr(ordermin, "BLOCK", block)
        got = {r["doc_id"]: r["class_id"] for r in ordermin.classes(frame(spark, rows)).collect()}
        assert got == want


def test_like_texts_at_the_border_share_a_sketch():
    rng, found = random.Random(14), 0
    for _ in range(300):
        a = [b"w%d" % rng.randrange(5000) for _ in range(400)]
        b = a[:]
        for i in rng.sample(range(400), 80):
            b[i] = b"new%d" % rng.randrange(10**9)
        assert ordermin.alike(a, b)
        found += bool((ordermin.sketch(a) == ordermin.sketch(b)).any())
    assert found >= 0.97 * 300


def test_profiles_bound_the_words():
    rng = random.Random(13)
    for _ in range(50):
        a = words(rng, 100)
        a, b = a.encode().split(), edited(rng, a, 0.2).encode().split()
        apart = int(abs(ordermin.profile(a).astype(int) - ordermin.profile(b)).sum())
        assert apart <= len(a) + len(b) - 2 * (Counter(a) & Counter(b)).total()


def test_empty_table(none):
    assert ordermin.classes(none).collect() == []
    assert ordermin.first_of_class(none).collect() == []


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 200)]
    pairs += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] + [(5, 5)]
    want = union(pairs, sorted({x for p in pairs for x in p if p[0] != p[1]}))
    df = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    assert {r["node"]: r["label"] for r in components(df).collect()} == want


def test_query_finds_what_all_pairs_find(spark):
    from tokenmill.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    docs = [(i, t) for i, t in docs]
    got = {r["doc_id"]: r["class_id"] for r in queries.QUERIES["op5_order_minhash"](spark, folder).collect()}
    assert len(got) == len(docs)
    assert got == brute(docs)


def test_rare_grams_of_similar_texts_meet():
    rng = random.Random(21)
    counts = np.random.default_rng(2).integers(1, 255, 1 << ordermin.COUNTERS).astype(np.uint8)
    counts[counts == 1] = 2
    met = 0
    for _ in range(3000):
        a = " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40)))
        b = edited(rng, a, 0.3)
        one, two = ([w.encode() for w in t.split()] for t in (a, b))
        if two and ordermin.alike(one, two):
            met += 1
            grams = (ordermin.rare_grams(ordermin.word_pairs(w), counts) for w in (one, two))
            assert set(next(grams).tolist()) & set(next(grams).tolist())
    assert met > 500


def test_crowded_groups_are_split_without_loss(spark, monkeypatch):
    """Unlike texts with one passage, and similar ones among them."""
    rng = random.Random(22)
    passage = words(rng, 80)
    rows = [(i, f"{words(rng, 40)} {passage} {words(rng, 40)}", "en", "a") for i in range(300)]
    rows += [(1000 + i, edited(rng, rows[i][1], 0.08), "en", "a") for i in range(60)]
    rows += [(2000 + i, edited(rng, rows[1000 % 300 - i][1], 0.12), "en", "a") for i in range(40)]
    sizes, split = [], ordermin._split

    def watched(crowd, texts):
        found = split(crowd, texts)
        sizes.append((crowd.count(), found.groupBy("key").count().agg({"count": "max"}).first()[0] or 0, found.count()))
        return found

    monkeypatch.setattr(ordermin, "_split", watched)
    monkeypatch.setattr(ordermin, "BLOCK", 64)
    got = {r["doc_id"]: r["class_id"] for r in ordermin.classes(frame(spark, rows)).collect()}
    assert got == brute(rows)
    (nodes, most, n), = sizes
    assert nodes > 250 and most < 64  # no longer crowded
    longest = max(len(t.split()) for _, t, *_ in rows)
    assert n <= nodes * (2 * longest // 5 + 1)


def test_rare_words_of_similar_texts_meet_at_about_one_place():
    rng = random.Random(31)
    counts = np.random.default_rng(3).integers(2, 1000, 1 << ordermin.COUNTERS).astype(np.int32)
    met = 0
    for _ in range(3000):
        a = " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40)))
        one, two = ([w.encode() for w in t.split()] for t in (a, edited(rng, a, 0.3)))
        if two and ordermin.alike(one, two):
            met += 1
            apart = max(len(one), len(two)) // 5
            places = [
                {w: (x, y) for w, x, y in zip(*(c.tolist() for c in ordermin.rare_words(ordermin.word_hashes(t), counts)))}
                for t in (one, two)
            ]
            assert len(places[0]) <= len(one) // 5 + 1
            assert any(
                places[0][w][0] <= places[1][w][1] + apart and places[1][w][0] <= places[0][w][1] + apart
                for w in places[0].keys() & places[1].keys()
            )
    assert met > 500


def test_groups_of_a_passage_send_each_node_once(spark, monkeypatch):
    """Unlike texts with one passage share many groups of more than 32 nodes: none of
    those is sent as it is, and texts without a partner leave no row."""
    rng = random.Random(32)
    own = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(45))
    passage = words(rng, 60)
    rows = [(i, f"{own()} {passage} {own()}", "en", "a") for i in range(150)]
    rows += [(1000 + i, edited(rng, rows[i][1], 0.1), "en", "a") for i in range(20)]
    sizes, stored = Counter(), ordermin.stored

    def watched(df, name, **more):
        found = stored(df, name, **more)
        if name in ("near-few", "near-split"):
            groups = found.groupBy("key", "scale").count()
            sizes[name] = groups.agg({"count": "max"}).first()[0] or 0
        return found

    monkeypatch.setattr(ordermin, "stored", watched)
    got = {r["doc_id"]: r["class_id"] for r in ordermin.classes(frame(spark, rows)).collect()}
    assert got == brute(rows)
    assert max(sizes.values()) <= 32, sizes


def test_nodes_of_groups_by_list_and_by_join(spark, monkeypatch):
    rows = [(i, i % 7, 50 + i, [i, i + 100, 7], [2 * (i % 2), 1]) for i in range(40)]
    nodes = spark.createDataFrame(rows, "node long, label long, n long, keys array<long>, scales array<long>")
    groups = spark.createDataFrame([(5, 2), (6, 2), (7, 2), (108, 1)], "key long, scale long")
    want = sorted((i, i % 7, 50 + i) for i in range(40) if i % 2 or i == 8)
    for listed in (1000, 0):
        monkeypatch.setattr(ordermin, "BROADCAST_ROWS", listed)
        assert sorted(map(tuple, ordermin._of_groups(nodes, groups).collect())) == want
