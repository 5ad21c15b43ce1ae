import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
from samples import frame, words
from tokenizers import Tokenizer

from tokenmill.llm import packing

PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def theirs():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def held(df, documents, window=1024):
    """Each id of each document lies in one piece; sequences are whole.
    Returns the sequences' lengths."""
    rows = df.collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
    # documents of one id are told apart by their checksums
    pieces = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    wanted = Counter()
    for doc_id, ids in documents:
        wanted[doc_id is not None, doc_id or 0, len(ids)] += len(ids)
    sums = Counter()
    for *key, start, length, _ in pieces:
        sums[tuple(key)] += length
    assert sums == wanted
    by_key = defaultdict(list)
    for doc_id, ids in documents:
        by_key[doc_id is not None, doc_id or 0, len(ids)].append(ids)
    for *key, start, length, number in pieces:
        assert any(crc(ids[start : start + length]) == number for ids in by_key[tuple(key)])
    for key, same in by_key.items():
        own = [p for p in pieces if list(p[:3]) == list(key)]
        covered = Counter(i for p in own for i in range(p[3], p[3] + p[4]))
        assert covered == {i: len(same) for i in range(key[2])}
    return [sum(n for _, n in p) for p in sequences.values()]


def test_odd_rows(odd, odd_rows, theirs):
    documents = [(r[0], theirs(r[1])) for r in odd_rows]
    sizes = held(packing.packed(odd, PATH, 0), documents)
    assert sum(n != 1024 for n in sizes) <= 1


@pytest.mark.parametrize(("window", "shard"), [(1024, 1024), (64, 16), (256, 7), (1, 100)])
def test_little_padding(spark, theirs, window, shard):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(0, 60)) if i % 4 else "one text that comes again", "en", "a") for i in range(300)]
    df = packing.packed(frame(spark, rows), PATH, 0, window, shard)
    sizes = held(df, [(r[0], theirs(r[1])) for r in rows], window)
    # a shard's last window alone may be short
    groups = {r["sequence_id"] >> 32 for r in df.collect() if not r["sequence_id"] % 2}
    assert sum(n < window for n in sizes) <= len(groups)
    if window > 1:
        assert len(groups) >= 300 // shard // 2


def test_scores_are_bm25():
    rng = np.random.default_rng(3)
    rests = [rng.integers(0, 30, rng.integers(1, 50)) for _ in range(40)]
    documents = np.array([sum(i in r for r in rests) for i in range(30)])
    weights = packing.inverse_frequency(documents, 40)
    mean = sum(map(len, rests)) / 40
    index = packing.Index(rests, weights, mean)
    for seed in range(40):
        scores = index.scores(seed)
        for d, rest in enumerate(rests):
            plain = 0.0
            for t in set(rests[seed].tolist()):
                n, tf = documents[t], rest.tolist().count(t)
                idf = max(0.0, math.log((40 - n + 0.5) / (n + 0.5)))
                plain += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(rest) / mean))
            assert abs(scores[d] - plain) < 1e-9


def plain_windows(index, sizes, window):
    """The greedy rule walked one rest at a time."""
    left = list(sizes)
    while max(left):
        seed = left.index(max(left))
        out, room = [(seed, sizes[seed] - left[seed], left[seed])], window - left[seed]
        left[seed] = 0
        ranked = sorted(range(len(left)), key=lambda d: (-index.scores(seed)[d], d))
        for one in ranked:
            if 0 < left[one] <= room:
                out.append((one, sizes[one] - left[one], left[one]))
                room, left[one] = room - left[one], 0
        for one in ranked:
            if room and left[one]:
                out.append((one, sizes[one] - left[one], room))
                left[one], room = left[one] - room, 0
        yield out


def test_windows_as_walked_plainly():
    rng = np.random.default_rng(5)
    rests = [rng.integers(0, 60, rng.integers(1, 64)) for _ in range(120)]
    weights = rng.random(60)
    index = packing.Index(rests, weights, 30.0)
    sizes = np.array([len(r) for r in rests])
    got = list(packing.filled(index, sizes, 64))
    assert got == [[tuple(map(int, p)) for p in w] for w in plain_windows(index, sizes.tolist(), 64)]


def test_neighbours_share_windows(spark):
    """Documents about the same words meet more often than by chance."""
    rng = random.Random(2)
    topics = [[f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{k}{j}" for j in range(12)] for k in range(6)]
    rows = [(i, " ".join(rng.choice(topics[i % 6]) for _ in range(25)), "en", "a") for i in range(240)]
    together = defaultdict(set)
    for r in packing.packed(frame(spark, rows), PATH, 0).collect():
        together[r["sequence_id"]].add(r["doc_id"])
    pairs = [(a % 6 == b % 6) for ids in together.values() for a in ids for b in ids if a < b]
    assert sum(pairs) / len(pairs) > 0.5  # 1 in 6 by chance


def test_shards_are_bounded():
    counts = {i: n for i, n in enumerate([5, 3000, 1, 1, 900, 200, 1024, 1025, 7])}
    base, number = packing.shards_of(counts, 9, 1024)
    held_ = Counter()
    for i, n in counts.items():
        for k in range(number[i]):
            held_[int(base[i]) + k] += n / number[i]
    assert max(held_.values()) <= 1024 and set(held_) == set(range(len(held_)))


def test_empty_table(none):
    assert packing.packed(none, PATH, 0).collect() == []
