import random

import numpy as np
import pytest

from tokenmill.llm import multiindex


def brute(codes, queries, k):
    out = {}
    for q, code in queries:
        near = {}
        for i, other in codes:
            if i != q:
                d = ((code ^ other) & ((1 << 64) - 1)).bit_count()
                near[i] = min(d, near.get(i, 65))
        best = sorted((d, i) for i, d in near.items())[:k]
        if best:
            out[q] = best
    return out


def check(spark, codes, queries, k=5):
    df = lambda rows: spark.createDataFrame(rows, "id long, code long").repartition(3)
    rows = multiindex.nearest(df(codes), df(queries), k).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found = got.setdefault(r["query_id"], [])
        found.append((r["distance"], r["id"]))
        assert r["rank"] == len(found)
    assert got == brute(codes, queries, k)


def signed(rng):
    return rng.getrandbits(64) - (1 << 63)


def near(rng, code, most):
    for _ in range(rng.randint(0, most)):
        code ^= 1 << rng.randrange(63)
    return code


@pytest.mark.parametrize("n", [0, 1, 3, 40])
def test_few_codes(spark, n):
    rng = random.Random(n)
    codes = [(i, signed(rng)) for i in range(n)]
    check(spark, codes, codes[:10])


def test_probing(spark):
    """Close neighbours and far ones."""
    rng = random.Random(1)
    centres = [signed(rng) for _ in range(150)]
    codes = [(i, near(rng, centres[i % 150], 6)) for i in range(3000)]
    codes += [(5000 + i, signed(rng)) for i in range(300)]
    queries = [c for c in codes if c[0] % 60 == 0] + [(9999, signed(rng))]
    check(spark, codes, queries)


def test_equal_codes_and_repeated_rows(spark):
    rng = random.Random(2)
    codes = [(i, 77 if i % 3 else signed(rng)) for i in range(1500)] + [(1, 77), (1, 77), (3, 12345)]
    check(spark, codes, [c for c in codes if c[0] % 50 == 0] + [(1, 77), (3, 12345)])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_given_vectors_end_by_radius(spark, sf, monkeypatch):
    """Whole tables as the query asks: every query's k-th distance is covered by
    the radii that were probed for it, and nothing but probes gives candidates."""
    codes = multiindex.sign_codes(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")).persist()
    known = [(r["id"], r["code"]) for r in codes.collect()]
    probed = []
    inner = multiindex._probes

    def watched(queries, cuts, radii):
        probed.append((len(cuts) * (radii[-1] + 1) - 1, {r["q"]: r["bound"] for r in queries.collect()}))
        return inner(queries, cuts, radii)

    monkeypatch.setattr(multiindex, "_probes", watched)
    rows = multiindex.nearest(codes, codes.where("id % 20 = 0"), 10).collect()
    want = brute(known, [c for c in known if c[0] % 20 == 0], 10)
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["distance"], r["id"]))
    assert got == want
    last = {}
    for covered, asked in probed:
        last |= dict.fromkeys(asked, covered)
    far = {code: want[i][-1][0] for i, code in known if i in want}
    assert last.keys() == far.keys()
    assert all(last[q] >= far[q] for q in far)


def test_segments_cover_the_code():
    for n in (1, 100, 10**5, 10**7, 10**10):
        cuts = multiindex.segments(n)
        assert sum(w for _, w in cuts) == 64
        assert [s for s, _ in cuts] == [sum(w for _, w in cuts[:i]) for i in range(len(cuts))]


def test_codes_of_vectors(spark):
    v = [1.0, -1.0, 0.0] * 21 + [2.0]
    rows = [(1, v), (None, v), (2, None), (3, [float("nan")] * 64), (4, [1.0, None]), (5, []), (6, v)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, code string")
    got = {r["id"]: r["code"] for r in multiindex.sign_codes(df).collect()}
    assert set(got) == {1, 3, 4, 5, 6} and got[1] == got[6] and got[3] == got[5] == 0
    bits = np.array(v) > 0
    assert [(got[1] >> (63 - i)) & 1 for i in range(64)] == bits.astype(int).tolist()
