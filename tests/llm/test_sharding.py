import zlib

import pytest

from tokenmill.llm import sharding
from samples import frame, words


def by_shard(rows):
    out = {}
    for r in rows:
        out.setdefault(r["shard"], []).append(r)
    return out


def check(rows, n):
    assert len(rows) == n
    for shard in by_shard(rows).values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))


def test_odd_rows(odd, odd_rows):
    rows = sharding.shard_by_bytes(odd).collect()
    check(rows, len(odd_rows))
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want


def test_near_equal_and_groups_whole(spark):
    import random

    rng = random.Random(1)
    texts = [words(rng, rng.randint(5, 30)) for _ in range(3000)]
    rows = [(i, texts[i % 2900], "en", "a") for i in range(4000)]
    got = sharding.shard_by_bytes(frame(spark, rows)).collect()
    check(got, 4000)
    sizes = [sum(r["size"] for r in s) for s in by_shard(got).values()]
    mean = sum(sizes) / 16
    assert len(sizes) == 16 and max(abs(s - mean) for s in sizes) < 0.03 * mean
    shards = {}
    for r in got:
        shards.setdefault(rows[r["doc_id"]][1], set()).add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


@pytest.mark.parametrize("unique_ids", [True, False])
def test_a_group_of_half_the_rows_spreads(spark, unique_ids):
    rows = [(i if unique_ids else 5, "hot text" if i % 2 else f"text {i}", "en", "a") for i in range(2000)]
    got = sharding.shard_by_bytes(frame(spark, rows)).collect()
    check(got, 2000)
    sizes = [sum(r["size"] for r in s) for s in by_shard(got).values()]
    assert len(sizes) == 16 and max(sizes) < 1.1 * sum(sizes) / 16


def test_splitters_are_exact(spark):
    rows = [(i, f"t{i * i}", "en", "a") for i in range(500)]
    keys = sharding.keyed(frame(spark, rows), "doc_id", "text").persist()
    cuts = sharding.splitters(keys, 4, 0.001, 0.02)
    whole = sorted(
        ((r["_k1"] << 120) | (r["_k2"] << 60) | r["_k3"], r["_size"]) for r in keys.collect()
    )
    total = sum(s for _, s in whole)
    for i, cut in enumerate(cuts, 1):
        below = sum(s for k, s in whole if k < cut)
        assert abs(below - total * i / 4) <= 4  # half of the largest row


def test_no_rows_and_one_row(spark, none):
    assert sharding.shard_by_bytes(none).collect() == []
    check(sharding.shard_by_bytes(frame(spark, [(1, "a", "en", "a")])).collect(), 1)


def test_no_python_in_the_plan(odd):
    plan = sharding.shard_by_bytes(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
