"""Vocabularies and the comparison of tokenizers split the texts once."""

from plain import SYMBOLS
from tokenmill.functions.words import split_chunks, split_pre_tokens, split_words
from tokenmill.operators.merges import merge_rules
from tokenmill.operators.vocabulary import vocabulary
from tokenmill.plans import corpus_vocabulary as cv
from tokenmill.plans.comparison import compare_tokenizers

SOURCE = "/root/testdata/sf0.001/documents.parquet"


def test_vocabularies_read_counts_not_texts(spark):
    texts = spark.read.parquet(SOURCE).select("text")
    for made in (
        cv.byte_level_vocabulary(split_words(texts), 50, 50),
        cv.wordpiece_vocabulary(split_chunks(texts), 50, 50),
        cv.substring_merges(split_pre_tokens(texts), 50),
    ):
        assert "sf0.001/documents" not in made._jdf.queryExecution().toString()


def test_comparison_in_place_equals_the_joined_one(spark):
    values = [None, "", " \n ", " a  b\tc", "x", "ab abc, ab's für 中文 Ünï", "abab ab " * 30]
    texts = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")

    def table(names):
        return vocabulary(spark.createDataFrame([(t, i) for i, t in enumerate(names)], "token string, token_id int"))

    rules = merge_rules(spark.createDataFrame([("a", "b", 0), ("ab", "ab", 1)], "left string, right string, rank int"))
    vocab, merged = table([*SYMBOLS, "ab", "Ġab"]), table([*SYMBOLS, "ab", "abab"])
    pieces = table(["[UNK]", "a", "##b", "ab", "x", "u", "##n", "##i"])
    got = compare_tokenizers(texts, vocab, rules, merged, pieces)
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Exchange" not in plan and "Join" not in plan
    joined = compare_tokenizers(texts, vocab, rules, merged, pieces, hot_rows=3)
    assert got.schema.simpleString() == joined.schema.simpleString()
    assert sorted(got.collect()) == sorted(joined.collect())
