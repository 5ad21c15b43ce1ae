from tokenmill.operators import accounts


def test_totals_and_comparison(spark):
    a = spark.createDataFrame([(1, "en", 5), (2, "en", 7)], "doc_id long, lang string, n_tokens int")
    b = spark.createDataFrame([(1, 9), (2, 3)], "doc_id long, n_tokens int")
    row = accounts.token_totals(a, ["lang"]).first()
    assert (row.n_texts, row.n_tokens, row.max_tokens) == (2, 12, 7)
    assert accounts.token_totals(a).first().n_tokens == 12
    got = {r.doc_id: (r.x, r.y) for r in accounts.compare_tokenizers({"x": a, "y": b}).collect()}
    assert got == {1: (5, 9), 2: (7, 3)}


def test_one_pass_comparison_equals_each_tokenizer(spark, docs):
    from pyspark.sql import functions as F

    from tokenmill.functions.hashing import hash_tokens
    from tokenmill.functions.words import split_chunks, split_pre_tokens, split_words
    from tokenmill.operators.greedy import greedy_encode
    from tokenmill.operators.merges import merge_encode, merge_rules
    from tokenmill.operators.vocabulary import vocabulary
    from tokenmill.operators.wordpiece import wordpiece_encode
    from tokenmill.plans import comparison
    from tokenmill.plans import corpus_vocabulary as cv
    from tokenmill.scratch import stored

    edge = [(10_000, None), (10_001, ""), (10_002, " \n "), (10_003, " a  b\tc"), (10_004, "x")]
    texts = docs.unionByName(spark.createDataFrame(edge, "doc_id long, text string"))
    vocab = vocabulary(stored(cv.byte_level_vocabulary(split_words(docs.select("text")), 900, 500), "cmp-vocab"))
    made = stored(cv.substring_merges(split_pre_tokens(docs.select("text")), 700), "cmp-merges")
    merges, merge_vocab = merge_rules(made), vocabulary(stored(cv.merge_vocabulary(made), "cmp-merge-vocab"))
    pieces = vocabulary(stored(cv.wordpiece_vocabulary(split_chunks(docs.select("text")), 700, 700), "cmp-pieces"))
    hashed = texts.withColumn("n_tokens", F.greatest(F.size(hash_tokens(F.col("text"))), F.lit(0)))
    want = accounts.compare_tokenizers(
        {
            "greedy": greedy_encode(texts, vocab),
            "merge_bpe": merge_encode(texts, merges, merge_vocab),
            "wordpiece": wordpiece_encode(texts, pieces),
            "hash": hashed,
        }
    )
    want = {tuple(r) for r in want.collect()}
    dictionary = comparison.unit_dictionary(texts, vocab, merges, merge_vocab, pieces)
    for bounds in ({}, {"hot_rows": 60}, {"hot_rows": 0}):
        got = comparison.compare_counts(texts, dictionary, **bounds)
        assert {tuple(r) for r in got.select("doc_id", "greedy", "merge_bpe", "wordpiece", "hash").collect()} == want
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = comparison.compare_counts(source, dictionary)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("sf0.001/documents.parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
