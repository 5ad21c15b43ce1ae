import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from plain import SYMBOLS
from tokenmill.functions.words import split_pre_tokens
from tokenmill.operators.merges import merge_encode, merge_rules
from tokenmill.operators.vocabulary import vocabulary
from tokenmill.plans.corpus_vocabulary import merge_vocabulary, substring_merges
from tokenmill.scratch import stored

tokenizers = pytest.importorskip("tokenizers")

EDGE = [
    "a\n\n b  c   d",
    "it's we'll I'm they've",
    "x1y22 333 !!! ... ?a",
    " lead and trail ",
    "für 😀 naïve 中文字符",
    "aaaaaaa aaaa aa",
    "\t\ttabs\r\nnew",
    "",
    "a b c",
]


def library(tokens, merges):
    model = tokenizers.models.BPE(vocab=tokens, merges=merges)
    made = tokenizers.Tokenizer(model)
    made.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    return made


def compare(spark, merges, values, rules=None):
    df = spark.createDataFrame(
        [(a, b, i) for i, (a, b) in enumerate(merges)], "left string, right string, rank int"
    )
    rules = rules or merge_rules(df)
    tokens = {s: i for i, s in enumerate(SYMBOLS)}
    for a, b in merges:
        tokens.setdefault(a + b, len(tokens))
    vocab = vocabulary(spark.createDataFrame(list(tokens.items()), "token string, token_id int"))
    texts = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    got = {r.doc_id: r.token_ids for r in merge_encode(texts, rules, vocab).collect()}
    made = library(tokens, merges)
    assert got == {i: made.encode(t).ids for i, t in enumerate(values)}
    return rules


MERGES = [("a", "a"), ("t", "h"), ("th", "e"), ("Ġ", "the"), ("aa", "aa"), ("Ġ", "a"), ("i", "n")]


def test_edges_match_library(spark):
    assert compare(spark, MERGES, EDGE).learned_order


def test_general_walk_matches_library(spark):
    df = spark.createDataFrame(
        [(a, b, i) for i, (a, b) in enumerate(MERGES)], "left string, right string, rank int"
    )
    rules = dataclasses.replace(merge_rules(df), learned_order=False)
    compare(spark, MERGES, EDGE, rules)


def test_rules_out_of_learned_order(spark):
    rng = random.Random(3)
    merges = [("ab", "c"), ("a", "b"), ("b", "c"), ("a", "bc"), ("c", "a"), ("abc", "ca")]
    values = ["".join(rng.choice("abc ") for _ in range(60)) for _ in range(60)]
    assert not compare(spark, merges, values).learned_order


def test_trained_merges_on_documents(spark, docs):
    rows = docs.collect()
    made = tokenizers.Tokenizer(tokenizers.models.BPE())
    made.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    trainer = tokenizers.trainers.BpeTrainer(
        vocab_size=1500, initial_alphabet=SYMBOLS, show_progress=False
    )
    made.train_from_iterator([r.text for r in rows], trainer)
    import json

    model = json.loads(made.to_str())["model"]
    merges = [tuple(m) for m in model["merges"]]
    df = spark.createDataFrame(
        [(a, b, i) for i, (a, b) in enumerate(merges)], "left string, right string, rank int"
    )
    rules = merge_rules(df)
    assert rules.learned_order
    vocab = vocabulary(
        spark.createDataFrame(list(model["vocab"].items()), "token string, token_id int")
    )
    want = {r.doc_id: made.encode(r.text).ids for r in rows}
    for bounds in ({}, {"hot_rows": 40}):
        encoded = merge_encode(docs, rules, vocab, **bounds)
        assert {r.doc_id: r.token_ids for r in encoded.collect()} == want


def test_pre_tokens_are_lossless(spark, docs):
    back = (
        split_pre_tokens(docs)
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("word_idx", "word"))).alias("w"))
        .select("doc_id", F.array_join(F.transform("w", lambda e: e["word"]), "").alias("text"))
    )
    assert back.exceptAll(docs).count() == 0


def test_substring_merges_are_in_learned_order(spark, docs):
    merges = stored(substring_merges(split_pre_tokens(docs.select("text")), 200), "merges")
    rules = merge_rules(merges)
    assert rules.learned_order and rules.longest <= 4
    assert vocabulary(merge_vocabulary(merges)).n_tokens == 456


def test_walk_is_not_repeated_for_every_symbol(spark):
    """A word of 100,000 letters: pieces from one walk, in one pass."""
    rules = merge_rules(
        spark.createDataFrame([("a", "b", 0), ("ab", "ab", 1)], "left string, right string, rank int")
    )
    vocab = vocabulary(spark.createDataFrame([("a", 1), ("b", 2), ("ab", 3), ("abab", 4)], "token string, token_id int"))
    texts = spark.createDataFrame([(1, "ab" * 50_001 + "a")], "doc_id long, text string")
    encoded = merge_encode(texts, rules, vocab)
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lambdafunction(aggregate" in line.replace(" ", "") for line in plan.splitlines())
    ids = encoded.first().token_ids
    assert ids == [4] * 25_000 + [3, 1]
