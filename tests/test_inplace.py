"""Texts are cut where they are: no words are shuffled or stored on the way."""

import os

import pytest
from pyspark.sql import functions as F

from plain import SYMBOLS, greedy
from test_wordpiece import EDGE as PIECE_EDGE
from tokenmill.functions.words import basic_tokens, chunk_list, text_basic_tokens
from tokenmill.operators.greedy import greedy_encode
from tokenmill.operators.merges import merge_encode, merge_rules
from tokenmill.operators.vocabulary import vocabulary
from tokenmill.operators.wordpiece import wordpiece_encode
from tokenmill.plans.batches import padded_batches
from tokenmill.scratch import scratch_dir


@pytest.fixture(scope="module")
def vocab(spark):
    tokens = {s: i for i, s in enumerate(SYMBOLS)} | {"ab": 300, "Ġabc": 301, "[UNK]": 302, "##a": 303}
    return vocabulary(spark.createDataFrame(list(tokens.items()), "token string, token_id int"))


def test_encoders_shuffle_and_store_nothing(spark, vocab):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rules = merge_rules(spark.createDataFrame([("a", "b", 0)], "left string, right string, rank int"))
    folder = f"{scratch_dir(spark).removeprefix('file:')}/{spark.sparkContext.applicationId}"
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    for encoded in (
        greedy_encode(texts, vocab),
        greedy_encode(texts, vocab, max_word_bytes=9, max_match_bytes=3),
        padded_batches(texts, vocab, 4),
        merge_encode(texts, rules, vocab),
        wordpiece_encode(texts, vocab, max_words=5),
    ):
        plan = encoded._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan
        assert encoded.count() >= 200
    assert set(os.listdir(folder)) == before


def test_many_batches_and_odd_rows(spark, vocab):
    """Nulls, texts without words and small batches; other columns are kept."""
    tokens = {r.token: r.token_id for r in vocab.tokens.collect()}
    values = [None, "", " \n ", " abc abc", "ab\n abc  ab ", "für 😀"] * 20
    rows = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(values)], "doc_id long, kind int, text string").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        got = {r.doc_id: (r.kind, r.token_ids, r.n_tokens) for r in greedy_encode(rows, vocab).collect()}
    finally:
        spark.conf.set(name, held)
    want = [greedy(t or "", tokens) for t in values]
    assert got == {i: (i % 3, ids, len(ids)) for i, ids in enumerate(want)}


def test_basic_tokens_of_texts_are_those_of_their_chunks(spark):
    values = [*PIECE_EDGE, " ".join(PIECE_EDGE), "a\tb\r\nc\x0bd\x1fe\x85f g h﻿i", "Σ\nΣΑΣ　가 x"]
    rows = spark.createDataFrame([(t,) for t in values], "text string")
    apart = F.flatten(F.transform(chunk_list("text"), basic_tokens))
    for r in rows.select(text_basic_tokens("text").alias("whole"), apart.alias("apart")).collect():
        assert r.whole == r.apart
