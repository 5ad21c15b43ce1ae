import json

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import measures
from tokenmill.sources import measurements as ms
from tokenmill.sources import layout, sinks
from tokenmill.sources.vocabularies import (
    load_bpe_vocabulary,
    load_merges,
    load_wordpiece_vocabulary,
)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_bpe_vocabulary(spark, tmp_path):
    tokens = {"a": 0, "Ġthe": 1, '"': 2, "\\": 3, "/": 4, "é": 5, "😀": 6, "\n": 7, "x": -1}
    path = write(tmp_path / "vocab.json", json.dumps(tokens))
    assert {r.token: r.token_id for r in load_bpe_vocabulary(spark, path).collect()} == tokens
    raw = '{"\\u0120b": 1, "\\/": 2, "t\\t": 3, "dup": 4, "dup": 5,\n "z": 6}'
    path = write(tmp_path / "raw.json", raw)
    got = {r.token: r.token_id for r in load_bpe_vocabulary(spark, path).collect()}
    assert got == {"Ġb": 1, "/": 2, "t\t": 3, "dup": 5, "z": 6}


def test_merges(spark, tmp_path):
    path = write(tmp_path / "merges.txt", "#version: 0.2\nĠ t\r\n# #\nh e\n\nĠt he\n")
    rows = [(r.left, r.right, r.rank) for r in load_merges(spark, path).orderBy("rank").collect()]
    assert rows == [("Ġ", "t", 0), ("#", "#", 1), ("h", "e", 2), ("Ġt", "he", 3)]


def test_wordpiece_vocabulary(spark, tmp_path):
    path = write(tmp_path / "vocab.txt", "[PAD]\n\n  [UNK] \nthe\n##ing\n")
    rows = load_wordpiece_vocabulary(spark, path).orderBy("token_id").collect()
    assert [r.token for r in rows] == ["[PAD]", "[UNK]", "the", "##ing"]
    assert [r.token_id for r in rows] == [0, 1, 2, 3]


# The header lines; the rows are invented.
CSV = {
    "comprehensive": "Scenario,PayloadKB,Iteration,TextGen_us,Tokenize_us,DPU_Total_us,RDMA_us,"
    "GPU_Compute_us,GPU_Util_Pct,GPU_Mem_MB,DPU_CPU_Pct\n"
    "A,1,warmup1,11.5,2.25,13.75,900.5,20.0,0.0,100,0\nA,1,2,12.5,2.5,15.0,40.25,21.5,1.5,200,0\n",
    "timing": "Scenario,PayloadKB,Run,TextGen_us,Tokenize_us,DPU_Total_us,RDMA_us,GPU_Compute_us\n"
    "B,1,1,14.5,0.00,14.5,45.75,30.5\n",
    "results": "Scenario,PayloadKB,Run,DPU_TextGen_us,DPU_Tokenize_us,RDMA_Latency_us,GPU_Compute_us,"
    "GPU_Util_Percent,GPU_Mem_MB\nA,1,1,0,17,950.25,22.5,0,0\n",
}


def test_measurement_shapes_in_one_table(spark, tmp_path):
    paths = {s: [write(tmp_path / f"{s}.csv", text)] for s, text in CSV.items()}
    df = ms.read_all_measurements(spark, paths)
    rows = {(r.scenario, r.run, r.is_warmup, r.transfer_us) for r in df.collect()}
    assert rows == {
        ("A", 1, True, 900.5), ("A", 2, False, 40.25), ("B", 1, False, 45.75), ("A", 1, False, 950.25),
    }
    assert df.filter("cpu_pct is null").count() == 2
    assert dict(df.dtypes)["gpu_util_pct"] == "double"
    assert measures.drop_warmup_rows(df).count() == 3


def test_a_mixed_folder_reads_by_its_own_headers(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    for i, (shape, text) in enumerate(CSV.items()):
        write(folder / f"{i}-any.csv", text)
        write(folder / f"{i}-crlf.csv", text.replace("\n", "\r\n"))
    write(folder / "odd.csv", CSV["timing"].replace("RDMA_us", "Other_us"))
    write(folder / "empty.csv", "")
    write(folder / "head.csv", CSV["results"].split("\n")[0] + "\n")
    headers = ms.file_headers(spark, str(folder))
    shapes = {r.file_path.rsplit("/", 1)[1]: r.shape for r in headers.collect()}
    names = list(CSV)
    assert shapes == {f"{i}-{k}.csv": names[i] for i in range(3) for k in ("any", "crlf")} | {"odd.csv": None, "head.csv": "results"}
    (unknown,) = ms.unknown_headers(headers).collect()
    assert unknown.file_path.endswith("odd.csv") and "Other_us" in unknown.header
    mixed = ms.read_mixed_measurements(spark, str(folder))
    paths = {s: [str(folder / f"{i}-any.csv")] for i, s in enumerate(CSV)}
    sorted_out = ms.read_all_measurements(spark, paths)
    assert dict(mixed.dtypes) == dict(sorted_out.dtypes)
    one = sorted(map(repr, sorted_out.select(*mixed.columns).collect()))
    assert sorted(map(repr, mixed.collect())) == sorted(2 * one)
    plan = mixed.select("*")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("FileScan text") == 1


def test_unexpected_header_is_refused(spark, tmp_path):
    path = write(tmp_path / "bad.csv", CSV["timing"].replace("RDMA_us", "Other_us"))
    with pytest.raises(Exception):
        ms.read_measurements(spark, path, "timing").collect()


def test_summary_with_three_header_lines(spark, tmp_path):
    text = (
        ",,TextGen_us,TextGen_us\n,,mean,std\nScenario,PayloadKB,,\n"
        "A,8,200.5,3.5,30.25,0.5,230.75,4.0,35.5,20.25,40.5,4.5,35.0,52.5,0.5,150.0,0.0\n"
    )
    row = ms.read_summary(spark, write(tmp_path / "s.csv", text)).first()
    assert (row.scenario, row.payload_kb, row.compute_us_max, row.cpu_pct_mean) == ("A", 8, 52.5, 0.0)


def test_log_markers(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write(logs / "a.log", "[12:00] DPU_TOKENIZE_TIME: 500.25 us\nnoise: 3\nLATENCY_RESULT: 800.5\n")
    write(logs / "b.log", "WORDPIECE_TIME: 4000.00\nWORDPIECE_TOKENS: 4500\nXWORDPIECE_TIME: 1\n")
    long = ms.read_log_markers(spark, str(logs))
    assert {(r.marker, r.value) for r in long.collect()} == {
        ("DPU_TOKENIZE_TIME", 500.25), ("LATENCY_RESULT", 800.5),
        ("WORDPIECE_TIME", 4000.0), ("WORDPIECE_TOKENS", 4500.0),
    }
    wide = {r.path.rsplit("/", 1)[1]: r for r in ms.markers_per_file(long).collect()}
    assert wide["a.log"].LATENCY_RESULT == 800.5 and wide["a.log"].WORDPIECE_TIME is None
    assert wide["b.log"].WORDPIECE_TOKENS == 4500


def test_nested_results(spark, tmp_path):
    entry = {
        "name": "BPE", "platform": "Host CPU", "implementation": "lib", "mean_us": 2.5,
        "min_us": 1.0, "max_us": 4.0, "std_us": 1.5, "tokens": 7, "iterations": 2, "text_bytes": 8192,
    }
    doc = {
        "payload_kb": 8, "text_bytes": 8192, "iterations": 2,
        "tokenizers": {"bpe": entry, "wordpiece": dict(entry, name="WordPiece", tokens=9)},
    }
    path = write(tmp_path / "r.json", json.dumps(doc, indent=2))
    results = ms.read_results(spark, path)
    rows = ms.explode_results(results)
    assert {(r.tokenizer, r.tokens) for r in rows.collect()} == {("bpe", 7), ("wordpiece", 9)}
    out = str(tmp_path / "out")
    sinks.write_results(ms.nest_results(rows), out)
    again = ms.explode_results(spark.read.schema(ms.RESULT_SCHEMA).json(out))
    assert again.exceptAll(rows).count() == 0


def test_sinks(spark, tmp_path):
    stats = spark.createDataFrame([("A", 1, 2.345678)], "Scenario string, PayloadKB int, Mean double")
    sinks.write_statistics(stats, str(tmp_path / "stats"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "stats")).collect()
    assert [r.asDict() for r in rows] == [{"Scenario": "A", "PayloadKB": "1", "Mean": "2.35"}]
    texts = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    batches = spark.createDataFrame([(1, 0, [5, 0])], "doc_id long, batch_idx int, token_ids array<int>")
    sinks.write_transfer(str(tmp_path / "t"), texts, batches)
    both = spark.read.option("mergeSchema", True).parquet(str(tmp_path / "t"))
    assert {r.mode for r in both.collect()} == {"A", "B"}
    sinks.write_tokens(batches.withColumn("lang", F.lit("en")), str(tmp_path / "p"), ["lang"])
    assert spark.read.parquet(str(tmp_path / "p")).first().lang == "en"


def test_keyed_tables_open_only_the_files_of_a_range(spark, tmp_path):
    path = str(tmp_path / "keyed")
    rows = [(i if i % 50 else None, f"t{i}") for i in range(1000)]
    schema = "doc_id long, text string"
    layout.write_keyed(spark.createDataFrame(rows, schema).repartition(5), path, "doc_id", 8)
    manifest = layout.read_manifest(spark, path).collect()
    assert sum(r.n_rows for r in manifest) == 1000 and sum(r.n_null for r in manifest) == 20
    edges = sorted((r.least, r.greatest) for r in manifest if r.least is not None)
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:])) and len(edges) >= 6
    whole = layout.read_keyed(spark, path, "doc_id")
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, spark.createDataFrame(rows, schema).collect()))
    some = layout.read_keyed(spark, path, "doc_id", 101, 160)
    assert sorted(r.doc_id for r in some.collect()) == [i for i in range(101, 161) if i % 50]
    wanted = [r.file for r in manifest if r.least is not None and r.least <= 160 and r.greatest >= 101]
    opened, named = ({f.rsplit("/", 1)[1] for f in files} for files in (some.inputFiles(), wanted))
    assert opened == named and len(wanted) <= 2
    plan = some.sortWithinPartitions("doc_id")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Exchange" not in plan
    assert layout.read_keyed(spark, path, "doc_id", 5000).collect() == []
    with pytest.raises(FileNotFoundError):
        layout.read_keyed(spark, str(tmp_path / "none"), "doc_id")


def test_a_rerun_replaces_a_keyed_table_as_a_whole(spark, tmp_path):
    path = tmp_path / "rerun"
    for n in (30, 10):
        layout.write_keyed(spark.range(n).withColumnRenamed("id", "k"), str(path), "k", 3)
        assert layout.read_keyed(spark, str(path), "k").count() == n
    names = [p.name for p in path.iterdir()]
    assert len([n for n in names if n.startswith("run-")]) == len([n for n in names if n.startswith("manifest-")]) == 1
    # a run that ended before its manifest is not seen
    spark.range(99).withColumnRenamed("id", "k").write.parquet(f"{path}/run-broken")
    (path / "manifest-99999999999999999999").mkdir()
    assert layout.read_keyed(spark, str(path), "k").count() == 10
    texts = spark.createDataFrame([(1, "ab"), (2, "c")], "doc_id long, text string")
    sinks.write_transfer(str(tmp_path / "both"), texts, texts.select("doc_id"), key="doc_id")
    assert layout.read_keyed(spark, str(tmp_path / "both/mode=A"), "doc_id", 2).first().doc_id == 2
