from tokenmill.functions.words import split_words
from tokenmill.operators.greedy import greedy_encode
from tokenmill.operators.vocabulary import vocabulary
from tokenmill.plans.batches import padded_batches
from tokenmill.plans.corpus_vocabulary import byte_level_vocabulary
from tokenmill.scratch import stored
from tokenmill.streaming.stream import encode_stream


def test_stream_equals_batch(spark, docs, tmp_path):
    vocab = vocabulary(
        stored(byte_level_vocabulary(split_words(docs.select("text")), 300, 300), "stream-vocab")
    )
    source = str(tmp_path / "in")
    docs.repartition(4).write.parquet(source)

    def run(out, **options):
        stream = (
            spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
        )
        query = encode_stream(stream, vocab, f"{tmp_path}/{out}", f"{tmp_path}/{out}-state", **options)
        query.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/{out}").drop("batch")

    whole = greedy_encode(docs, vocab)
    got = run("tokens")
    assert got.count() == docs.count()
    assert got.exceptAll(whole.select(*got.columns)).count() == 0

    # a second run finds the input read and leaves the output as it is
    assert run("tokens").count() == docs.count()

    padded = padded_batches(docs, vocab, 4)
    got = run("padded", batch_size=4)
    assert got.count() == padded.count()
    assert got.exceptAll(padded.select(*got.columns)).count() == 0


def test_stream_leaves_no_tables_and_takes_no_input(spark, docs, tmp_path):
    import os

    from tokenmill.scratch import scratch_dir

    vocab = vocabulary(
        stored(byte_level_vocabulary(split_words(docs.select("text")), 300, 300), "stream-vocab")
    )
    folder = f"{scratch_dir(spark).removeprefix('file:')}/{spark.sparkContext.applicationId}"

    def run(source):
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(source)
        query = encode_stream(stream, vocab, f"{source}-out", f"{source}-state")
        query.awaitTermination()

    source = str(tmp_path / "some")
    docs.repartition(4).write.parquet(source)
    before = set(os.listdir(folder))
    run(source)
    assert set(os.listdir(folder)) == before
    assert spark.read.parquet(f"{source}-out").count() == docs.count()
    assert len([f for f in os.listdir(f"{source}-out") if f.startswith("batch=")]) == 2
    none = str(tmp_path / "none")
    os.mkdir(none)
    run(none)
    assert not os.path.exists(f"{none}-out")


def test_known_words_are_not_cut_again(spark, tmp_path):
    """A second batch of the same words adds none; a run that stopped after the
    first batch goes on from the checkpoint with the same rows."""
    vocab = vocabulary(
        spark.createDataFrame([(s, i) for i, s in enumerate(["a", "b", "c", "ab", "Ġ", "Ġab", "bc"])], "token string, token_id int")
    )
    source = str(tmp_path / "in")
    parts = [["ab abc", "c ab"], ["abc ab", "ab c ab"], ["ab newc", "bcbc"]]
    schema = "doc_id long, text string"

    def add(k):
        rows = [(10 * k + i, t) for i, t in enumerate(parts[k])]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{k}")

    def run(out):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        encode_stream(stream, vocab, f"{tmp_path}/{out}", f"{tmp_path}/{out}-state").awaitTermination()
        return {r.doc_id: r.token_ids for r in spark.read.parquet(f"{tmp_path}/{out}").collect()}

    for k in range(3):
        add(k)
        stepped = run("stepped")
    whole = run("whole")
    texts = spark.createDataFrame([(10 * k + i, t) for k, p in enumerate(parts) for i, t in enumerate(p)], schema)
    assert stepped == whole == {r.doc_id: r.token_ids for r in greedy_encode(texts, vocab).collect()}
    (words,) = (tmp_path / "stepped-state-words").iterdir()
    added = {int(d.name.split("=")[1]): spark.read.parquet(str(d)) for d in words.iterdir() if d.name.startswith("batch=")}
    met = {k: sorted(r.word for r in df.collect()) for k, df in added.items()}
    assert met == {-1: [], 0: ["ab", "abc", "c"], 1: [], 2: ["bcbc", "newc"]}
