import public_tokenizers as public
import tiktoken

import corpus_pipeline
from samples import CLASH
from tokenmill.llm import bpe, mixing, ordermin, quality

FOLDER = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").persist()
    kept = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER).persist()
        rows, before = out.collect(), docs.collect()
        if number < 4:
            assert out.columns == COLUMNS
            known = {r["doc_id"]: r for r in before}
            assert all(known[r["doc_id"]] == r for r in rows)
        kept[name] = [r["doc_id"] for r in rows]
        if name == "quality rules":
            refs = quality.references(docs)
            want = {r["doc_id"] for r in before if quality.judge(r["text"], refs[r["lang"]], quality.Limits())[-1]}
            assert set(kept[name]) == want and len(kept[name]) == len(want)
        elif name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            judged = [(i in set(kept[name]), labels[i]) for i in known if i in labels]
            clean = [k for k, toxic in judged if not toxic]
            toxic = [k for k, toxic in judged if toxic]
            assert sum(clean) > 0.97 * len(clean) and sum(toxic) < 0.3 * len(toxic)
        elif name == "near-dedup":
            classes = {r["doc_id"]: r["class_id"] for r in ordermin.classes(docs).collect()}
            assert sorted(kept[name]) == sorted(set(classes.values()))
        elif name == "mixing":
            taken = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixing.taken_words(docs).collect()}
            assert sorted(kept[name]) == sorted(i for i, n in taken.items() for _ in range(n))
        docs = out
    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = bpe.load_ranks(file.read())
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows:
        assert r["round_trip"] and r["ids"] == enc.encode_ordinary(known[r["doc_id"]]["text"])


def test_stages_with_odd_rows(spark, odd, none):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, FOLDER).collect()
        assert stage(spark, none, FOLDER).collect() == []
    mixed = corpus_pipeline.mixing_stage(spark, odd, FOLDER)
    assert mixed.columns == [*COLUMNS, *CLASH]


def test_run_is_the_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda df: sorted((r["doc_id"], r["n_tokens"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(docs)
