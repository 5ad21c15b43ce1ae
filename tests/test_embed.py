import math

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import embed

WORD = {0: [0.0, 0.5], 1: [1.0, -1.0], 2: [0.25, 2.0]}
POS = {0: [0.1, 0.2], 1: [0.3, 0.4]}
TYPE = {0: [1.0, 1.0], 1: [9.0, 9.0]}
GAMMA, BETA = [0.5, 2.0], [0.1, -0.1]


def vectors(spark, rows, key):
    return spark.createDataFrame(list(rows.items()), f"{key} long, vec array<float>")


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [(0, i, t) for i, t in enumerate([0, 1, 2, 3, -5, 1, 30522])]
    return spark.createDataFrame(rows, "doc_id long, pos int, token_id int")


def test_lookup_out_of_range_is_row_zero(spark, tokens):
    word = vectors(spark, WORD, "token_id")
    for bounds in ({}, {"max_rows": 1}, {"max_bytes": 1}):
        rows = embed.embedding_lookup(tokens, word, **bounds).collect()
        assert len(rows) == 7
        for r in rows:
            assert r.vec == pytest.approx(WORD.get(r.token_id, WORD[0]))


def test_formula(spark, tokens):
    rows = embed.bert_embedding(
        tokens,
        vectors(spark, WORD, "token_id"),
        vectors(spark, POS, "pos"),
        vectors(spark, TYPE, "type_id"),
        GAMMA,
        BETA,
        F.lit(2),
    ).collect()
    for r in rows:
        word = WORD.get(r.token_id, WORD[0])
        f32 = [float(x) for x in POS[r.pos % 2]]
        want = [
            math.tanh((w + p + t) * g + b)
            for w, p, t, g, b in zip(word, f32, TYPE[0], GAMMA, BETA)
        ]
        assert r.vec == pytest.approx(want, abs=1e-6)


def test_a_full_size_table_is_sent_and_nothing_is_shuffled(spark, tokens):
    """30,522 rows of 768: one narrow pass over the tokens."""
    word = spark.range(30_522).select(
        F.col("id").alias("token_id"), F.array_repeat(F.col("id").cast("float"), 768).alias("vec")
    )
    rows = embed.embedding_lookup(tokens, word)
    assert {r.token_id: (r.row_id, r.vec[767], len(r.vec)) for r in rows.collect()} == {
        0: (0, 0.0, 768), 1: (1, 1.0, 768), 2: (2, 2.0, 768), 3: (3, 3.0, 768), -5: (0, 0.0, 768), 30522: (0, 0.0, 768),
    }
    plan = rows._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


def test_steps_agree_with_the_whole_and_with_a_joined_table(spark, tokens):
    word, pos, kind = vectors(spark, WORD, "token_id"), vectors(spark, POS, "pos"), vectors(spark, TYPE, "type_id")

    def by_place(df):
        return {r.pos: r.vec for r in df.collect()}

    whole = by_place(embed.bert_embedding(tokens, word, pos, kind, GAMMA, BETA, F.lit(2)))
    for bounds in ({}, {"max_rows": 0}):
        found = embed.embedding_lookup(tokens, word, **bounds)
        steps = by_place(embed.affine_tanh(embed.embedding_sum(found, pos, kind, F.lit(2)), GAMMA, BETA))
        assert steps.keys() == whole.keys()
        for place, vec in steps.items():
            assert vec == pytest.approx(whole[place])


def test_no_row_zero_and_no_place_give_null(spark, tokens):
    word = vectors(spark, {1: [1.0, -1.0]}, "token_id")
    rows = {r.token_id: r.vec for r in embed.embedding_lookup(tokens, word).collect()}
    assert rows[1] == [1.0, -1.0] and rows[2] is None and rows[0] is None
    summed = embed.embedding_sum(
        embed.embedding_lookup(tokens, word), vectors(spark, POS, "pos"), vectors(spark, TYPE, "type_id"), F.lit(99)
    )
    got = {(r.pos, r.token_id): r.vec for r in summed.collect()}
    assert got[1, 1] == pytest.approx([2.3, 0.4], abs=1e-6) and got[5, 1] is None and got[0, 0] is None
    none = spark.createDataFrame([], "doc_id long, pos int, token_id int")
    assert embed.embedding_lookup(none, word).collect() == []


def test_steps_are_one_pass_and_sums_leave_it(spark, tokens):
    """Vectors of several steps are made and added up in one narrow pass; the sums
    are those of the vectors, also where a row has none."""
    word, pos, kind = vectors(spark, WORD, "token_id"), vectors(spark, POS, "pos"), vectors(spark, TYPE, "type_id")
    rows = tokens.withColumn("doc_id", F.expr("if(pos = 6, null, pos div 3)"))
    without = vectors(spark, {1: [1.0, -1.0]}, "token_id")
    for table, bounds, n in ((word, {}, 2), (word, {"max_rows": 0}, 2), (without, {}, 99)):
        found = embed.embedding_lookup(rows, table, **bounds)
        made = embed.affine_tanh(embed.embedding_sum(found, pos, kind, F.lit(n)), GAMMA, BETA)
        sums = embed.vector_sums(made, ["doc_id"])
        if not bounds:
            for df in (made, sums):
                plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("== Initial")[0]
                assert plan.count("MapInArrow") == 1
        want = {}
        for r in made.collect():
            held = want.setdefault(r.doc_id, [0, None, None])
            held[0] += 1
            if r.vec is not None:
                held[1:] = [(held[1] or 0) + sum(r.vec), (held[2] or 0) + r.vec[0]]
        got = {r.doc_id: [r.n_vectors, r.sum_all, r.sum_first] for r in sums.collect()}
        assert got.keys() == want.keys()
        for doc_id, row in want.items():
            assert got[doc_id] == pytest.approx(row, nan_ok=True) if None not in row else got[doc_id] == row


def test_places_beyond_the_bounds_are_sent_as_far_as_they_occur(spark, tokens):
    word, kind = vectors(spark, WORD, "token_id"), vectors(spark, TYPE, "type_id")
    pos = spark.range(5000).select(F.col("id").alias("pos"), F.array_repeat(F.col("id").cast("float"), 2).alias("vec"))
    found = embed.embedding_lookup(tokens, word)
    whole = embed.embedding_sum(found, pos, kind, F.lit(5000)).collect()
    got = embed.embedding_sum(found, pos, kind, F.lit(5000), max_rows=100).collect()
    assert sorted(got, key=lambda r: r.pos) == sorted(whole, key=lambda r: r.pos)
