import random

import pytest
from pyspark.sql import functions as F

from plain import SYMBOLS, greedy, spaced_words
from tokenmill.functions.words import split_words
from tokenmill.operators.decode import decode_tokens
from tokenmill.operators.dictionary import (
    greedy_dictionary,
    segment_words,
    whole_word_hits,
    whole_word_misses,
    word_counts,
    word_forms,
)
from tokenmill.operators.greedy import greedy_encode, token_positions, truncate_tokens
from tokenmill.operators.vocabulary import vocabulary
from tokenmill.plans.corpus_vocabulary import byte_level_vocabulary
from tokenmill.scratch import stored

EDGE = [
    " a b",
    "a  b",
    "a ",
    "a\nb\tc\n d",
    "a\r\nb",
    " \n\t ",
    "",
    "für 😀",
    "z za",
    "abcd abd",
    "ab",
    "c abc",
    "z z abz zab",
    "\n a\t b c",
    " ".join(["abcz"] * 40),
]
SMALL = {"a": 0, "ab": 1, "abc": 2, "c": 3, "d": 4, "Ġ": 5, "Ġab": 6, "Ġabd": 7, "b": 8}


def table(spark, tokens):
    return vocabulary(spark.createDataFrame(list(tokens.items()), "token string, token_id int"))


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def ids(df):
    return {r.doc_id: r.token_ids for r in df.collect()}


def full_alphabet():
    return {s: i for i, s in enumerate(SYMBOLS)}


@pytest.fixture(scope="module")
def corpus_vocab(spark, docs):
    words = split_words(docs.select("text"))
    return vocabulary(stored(byte_level_vocabulary(words, 1500, 800), "test-vocab"))


def as_dict(vocab):
    return {r.token: r.token_id for r in vocab.tokens.collect()}


def test_words_and_spaces(spark):
    rows = split_words(texts(spark, EDGE)).filter("word is not null").collect()
    for i, text in enumerate(EDGE):
        got = sorted((r.word_idx, r.word, r.has_space) for r in rows if r.doc_id == i)
        assert [(w, s) for _, w, s in got] == spaced_words(text)


@pytest.mark.parametrize(
    "drop", [[], ["Ġ"], ["b"], ["Ġ", "a", "b"], ["a", "ab", "abc", "b", "c"]]
)
def test_edges_with_partial_alphabets(spark, drop):
    tokens = {t: i for t, i in SMALL.items() if t not in drop}
    vocab = table(spark, tokens)
    assert not vocab.covers_all_bytes
    got = ids(greedy_encode(texts(spark, EDGE), vocab))
    assert got == {i: greedy(t, tokens) for i, t in enumerate(EDGE)}


def test_edges_with_full_alphabet(spark):
    tokens = full_alphabet() | {t: 256 + i for t, i in SMALL.items() if len(t) > 1}
    vocab = table(spark, tokens)
    assert vocab.covers_all_bytes and vocab.space_id == 32
    got = ids(greedy_encode(texts(spark, EDGE), vocab))
    assert got == {i: greedy(t, tokens) for i, t in enumerate(EDGE)}


def test_negative_ids_are_misses(spark):
    vocab = table(spark, {"a": 0, "b": 1, "ab": -3})
    assert ids(greedy_encode(texts(spark, ["ab"]), vocab)) == {0: [0, 1]}


def test_documents(spark, docs, corpus_vocab):
    tokens = as_dict(corpus_vocab)
    got = ids(greedy_encode(docs, corpus_vocab))
    assert got == {r.doc_id: greedy(r.text, tokens) for r in docs.collect()}


def test_hot_and_rare_words_agree(spark, docs, corpus_vocab):
    whole = ids(greedy_encode(docs, corpus_vocab))
    for bounds in ({"hot_rows": 50}, {"hot_bytes": 2000}, {"hot_rows": 0}):
        assert ids(greedy_encode(docs, corpus_vocab, **bounds)) == whole


def test_one_word_is_a_third_of_the_rows(spark, corpus_vocab):
    tokens = as_dict(corpus_vocab)
    rng = random.Random(1)
    values = [
        " ".join(
            "qqhotqq" if rng.random() < 0.34 else f"w{rng.randrange(5000)}" for _ in range(300)
        )
        for _ in range(60)
    ]
    df = texts(spark, values)
    want = {i: greedy(t, tokens) for i, t in enumerate(values)}
    assert ids(greedy_encode(df, corpus_vocab)) == want
    assert ids(greedy_encode(df, corpus_vocab, hot_rows=3)) == want


def test_result_does_not_depend_on_partitions(spark, docs, corpus_vocab):
    want = ids(greedy_encode(docs, corpus_vocab))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert ids(greedy_encode(docs, corpus_vocab, hot_rows=100)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


WINDOW, BLOCK = 256, 512


def test_long_words_cross_windows_and_blocks(spark):
    rng = random.Random(7)
    tokens = full_alphabet()
    for _ in range(400):
        piece = "".join(rng.choice("abcde") for _ in range(rng.randint(2, 9)))
        tokens.setdefault(piece, len(tokens))
    values = [
        "".join(rng.choice("abcdeé") for _ in range(n))
        for n in (WINDOW - 1, WINDOW, WINDOW + 1, 3 * WINDOW + 5, 4 * BLOCK)
    ]
    got = ids(greedy_encode(texts(spark, values), table(spark, tokens)))
    assert got == {i: greedy(t, tokens) for i, t in enumerate(values)}


def test_word_and_match_limits(spark, docs, corpus_vocab):
    tokens = as_dict(corpus_vocab)
    got = ids(greedy_encode(docs, corpus_vocab, max_word_bytes=9, max_match_bytes=3))
    assert got == {
        r.doc_id: greedy(r.text, tokens, max_word=9, max_match=3) for r in docs.collect()
    }


def test_truncation_is_a_prefix(spark, docs, corpus_vocab):
    whole = ids(greedy_encode(docs, corpus_vocab))
    cut = ids(truncate_tokens(greedy_encode(docs, corpus_vocab), 10))
    limited = ids(greedy_encode(docs, corpus_vocab, max_tokens=10))
    assert cut == limited == {k: v[:10] for k, v in whole.items()}


def test_positions(spark, corpus_vocab):
    encoded = greedy_encode(texts(spark, ["a b c", ""]), corpus_vocab)
    rows = token_positions(encoded).orderBy("pos").collect()
    assert [(r.pos, r.token_id) for r in rows] == list(enumerate(ids(encoded)[0]))


def test_dictionary_reused_for_other_texts(spark, docs, corpus_vocab):
    words = greedy_dictionary(split_words(docs.select("text")), corpus_vocab)
    half = docs.filter("doc_id % 2 = 0")
    assert ids(greedy_encode(half, corpus_vocab, dictionary=words)) == ids(
        greedy_encode(half, corpus_vocab)
    )


def test_hits_and_misses_split_the_forms(spark, docs, corpus_vocab):
    forms = word_forms(split_words(docs.select("text"))).persist()
    hits = whole_word_hits(forms, corpus_vocab)
    misses = whole_word_misses(forms, corpus_vocab)
    assert hits.count() + misses.count() == forms.count()
    total = word_counts(split_words(docs.select("text"))).agg(F.sum("n_occ")).first()[0]
    assert forms.agg(F.sum("n_occ")).first()[0] == total


def test_decode_restores_words(spark, docs, corpus_vocab):
    encoded = greedy_encode(docs, corpus_vocab)
    back = {r.doc_id: r.text for r in decode_tokens(encoded, corpus_vocab).collect()}
    for r in docs.collect():
        want = "".join(
            (" " if space and i else "") + word
            for i, (word, space) in enumerate(spaced_words(r.text))
        )
        assert back[r.doc_id] == want


def test_decode_and_cut_send_nothing(spark, docs, corpus_vocab):
    rows = spark.range(3).select("id", F.array(F.lit(1)).alias("token_ids"), F.lit("ab").alias("word"))
    for made in (
        decode_tokens(rows, corpus_vocab, ["id"]),
        segment_words(rows.select("word"), corpus_vocab),
    ):
        plan = made._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


def test_decode_skips_unknown_ids(spark):
    vocab = table(spark, {"a": 0, "Ġb": 1})
    df = spark.createDataFrame([(1, [0, 99, 1]), (2, [])], "doc_id long, token_ids array<int>")
    raw = {r.doc_id: r.text for r in decode_tokens(df, vocab, mode="raw").collect()}
    assert raw == {1: "aĠb", 2: ""}
    plain = {r.doc_id: r.text for r in decode_tokens(df, vocab).collect()}
    assert plain == {1: "a b", 2: ""}


def test_encode_plan_shuffles_texts_only_once(spark, docs, corpus_vocab):
    words = greedy_dictionary(split_words(docs.select("text")), corpus_vocab)
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = greedy_encode(source, corpus_vocab, dictionary=words)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in physical and "Python" not in physical


def test_hot_words_are_chosen_without_ordering_words(spark):
    from tokenmill.operators.dictionary import Dictionary, hot_words

    rows = [(f"w{i}", n, 10) for i, n in enumerate([1000, 1004, 57, 57, 3, 3, 1, 1, 1])]
    table = spark.createDataFrame(rows, "word string, n_occ long, n_bytes long")
    for max_rows, max_bytes, want in ((9, 90, 9), (4, 90, 4), (5, 90, 4), (9, 25, 2), (1, 90, 0), (0, 0, 0)):
        chosen = hot_words(Dictionary(table, 9, 90), max_rows, max_bytes)
        assert chosen.count() == want
        plan = chosen._jdf.queryExecution().toString()
        assert "TakeOrdered" not in plan and "Window" not in plan
