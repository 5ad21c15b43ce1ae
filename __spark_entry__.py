
from __future__ import annotations

import sys
from collections.abc import Callable
from importlib import import_module
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.functions import bytelevel, shape, synth
from tokenmill.functions.hashing import BPE_MODULUS, WORDPIECE_MODULUS, hash_tokens
from tokenmill.functions.words import (
    basic_tokens,
    normalize,
    split_chunks,
    split_pre_tokens,
    split_words,
)
from tokenmill.operators import accounts, dictionary, embed, measures, ranking
from tokenmill.operators.decode import decode_tokens
from tokenmill.operators.greedy import greedy_encode, token_positions, truncate_tokens
from tokenmill.operators.merges import MergeRules, merge_encode, merge_rules
from tokenmill.operators.vocabulary import Vocabulary, vocabulary
from tokenmill.operators.wordpiece import wordpiece_encode
from tokenmill.plans import corpus_vocabulary as cv
from tokenmill.plans.batches import batch_sweep, padded_batches, transfer_modes
from tokenmill.plans.comparison import compare_tokenizers
from tokenmill.scratch import new_path, stored
from tokenmill.sources import layout, measurements, sinks, vocabularies
from tokenmill.streaming.stream import encode_stream

import oracles


def _optional(name: str, needed: str):
    """A module that may be left out together with the package it is built on;
    any other error is raised."""
    try:
        return import_module(name)
    except ModuleNotFoundError as error:
        missing = f"{error.name}."
        if error.name is None or not any(f"{n}.".startswith(missing) for n in (name, needed)):
            raise
        return None


LLM = "tokenmill.llm"
llm = _optional(f"{LLM}.queries", LLM)
corpus_pipeline = _optional("corpus_pipeline", LLM)

BATCH = 8
SEED = 42
STREAM_FILES = 8
RESULT_FILES = 8
EVENT_TYPES = ["signup", "purchase", "error", "view", "click"]


# -- inputs ------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", *more, "text")


_fixtures: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    """Vocabularies are fixed inputs of the tokenizers: derived once per
    session from the documents and kept as files."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _fixtures:
        _fixtures[key] = make()
    return _fixtures[key]


def _vocab(spark: SparkSession, sf_dir: str) -> Vocabulary:
    def make():
        words = split_words(_texts(spark, sf_dir).select("text"))
        made = cv.byte_level_vocabulary(words, oracles.VOCAB_WORDS, oracles.VOCAB_PIECES)
        return vocabulary(stored(made, "vocab"))

    return _once(spark, sf_dir, "vocab", make)


def _wp_vocab(spark: SparkSession, sf_dir: str) -> Vocabulary:
    def make():
        chunks = split_chunks(_texts(spark, sf_dir).select("text"))
        made = cv.wordpiece_vocabulary(chunks, oracles.PIECE_WORDS, oracles.PIECE_PARTS)
        return vocabulary(stored(made, "wp-vocab"))

    return _once(spark, sf_dir, "wp-vocab", make)


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        tokens = split_pre_tokens(_texts(spark, sf_dir).select("text"))
        return stored(cv.substring_merges(tokens, oracles.MERGE_RULES), "merges")

    return _once(spark, sf_dir, "rules", make)


def _merges(spark: SparkSession, sf_dir: str) -> tuple[MergeRules, Vocabulary]:
    def make():
        merges = _rules(spark, sf_dir)
        return merge_rules(merges), vocabulary(stored(cv.merge_vocabulary(merges), "merge-vocab"))

    return _once(spark, sf_dir, "merges", make)


def _joined(encoded: DataFrame) -> DataFrame:
    """Token IDs as one string, comparable across engines."""
    ids = F.array_join(F.transform("token_ids", lambda t: t.cast("string")), " ")
    return encoded.withColumn("token_ids", ids)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measurements: type as scenario, a payload size per user."""
    return _read(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("event_type").alias("scenario"),
        F.pow(F.lit(2), F.col("user_id") % 8).cast("int").alias("payload_kb"),
        F.col("value").alias("time_us"),
    )


def _exact_sum(column: str):
    """Hundredths add up exactly, in any order."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def _platform_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One time per algorithm (event type) and platform (user group)."""
    return (
        _events(spark, sf_dir)
        .withColumn("platform", F.concat(F.lit("p"), (F.col("user_id") % 16).cast("string")))
        .groupBy(F.col("scenario").alias("algo"), "platform")
        .agg(_exact_sum("time_us").alias("time_us"))
    )


def _stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One time per scenario (payload size) and stage (event type)."""
    return (
        _events(spark, sf_dir)
        .groupBy("payload_kb", F.col("scenario").alias("stage"))
        .agg(_exact_sum("time_us").alias("time_us"))
    )


def _wide_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _events(spark, sf_dir)
        .groupBy("user_id")
        .pivot("scenario", EVENT_TYPES)
        .agg(_exact_sum("time_us"))
    )


# -- text --------------------------------------------------------------------


def scan_payloads(spark, sf_dir):
    sources = {
        "documents": (F.col("doc_id").cast("string"), "text"),
        "conversations": (F.concat_ws(":", "conv_id", "turn"), "text"),
        "pages": (F.col("page_id").cast("string"), "html"),
        "benchmark": (F.col("item_id").cast("string"), "text"),
    }
    parts = [
        _read(spark, sf_dir, name).select(
            F.lit(name).alias("source"),
            key.alias("text_key"),
            F.length(text).cast("long").alias("n_chars"),
            F.octet_length(text).cast("long").alias("n_bytes"),
        )
        for name, (key, text) in sources.items()
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def byte_alphabet(spark, sf_dir):
    symbols = bytelevel.to_byte_symbols(F.col("text"))
    return (
        _texts(spark, sf_dir)
        .withColumn("symbols", symbols)
        .select(
            "doc_id",
            F.md5(F.encode("symbols", "UTF-8")).alias("symbols_md5"),
            F.length("symbols").cast("long").alias("n_symbols"),
        )
    )


def byte_round_trip(spark, sf_dir):
    there = bytelevel.to_byte_symbols(F.col("text"))
    back = bytelevel.from_byte_symbols(there)
    return _texts(spark, sf_dir).select(
        "doc_id", F.md5(F.encode(back, "UTF-8")).alias("text_md5")
    )


def word_split(spark, sf_dir):
    return (
        split_words(_texts(spark, sf_dir))
        .filter(F.col("word").isNotNull())
        .select("doc_id", F.col("word_idx").cast("long").alias("word_idx"), "word", "has_space")
    )


def pre_tokens(spark, sf_dir):
    return (
        split_pre_tokens(_texts(spark, sf_dir))
        .filter(F.col("word").isNotNull())
        .select(
            "doc_id", F.col("word_idx").cast("long").alias("idx"), F.col("word").alias("token")
        )
    )


def wordpiece_normalize(spark, sf_dir):
    counts = dictionary.word_counts(split_chunks(_texts(spark, sf_dir).select("text")))
    return counts.select(
        F.col("word").alias("chunk"), normalize(F.col("word")).alias("normal"), "n_occ"
    )


def basic_token_counts(spark, sf_dir):
    counts = dictionary.word_counts(split_chunks(_texts(spark, sf_dir).select("text")))
    return (
        counts.select(F.explode(basic_tokens(F.col("word"))).alias("token"), "n_occ")
        .groupBy("token")
        .agg(F.sum("n_occ").alias("n_occ"))
    )


def batch_slices(spark, sf_dir):
    return shape.batch_slices(_texts(spark, sf_dir), BATCH).select(
        "doc_id",
        F.col("batch_idx").cast("long").alias("batch_idx"),
        F.col("seq_len").cast("long").alias("seq_len"),
        F.hex(F.encode("text", "ISO-8859-1")).alias("slice_hex"),
    )


def payload_clamp(spark, sf_dir):
    n = F.octet_length("text")
    return _texts(spark, sf_dir).select(
        "doc_id",
        shape.clamp_payload_kb(F.ceil(n / 1024)).cast("long").alias("payload_kb"),
        shape.clamp_transfer(n * 4).cast("long").alias("transfer_bytes"),
    )


def gen_pattern_text(spark, sf_dir):
    text = synth.pattern_text(F.col("n_chars"))
    return _read(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.cast("binary")).alias("text_md5")
    )


def gen_random_text(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    text = synth.random_text(F.col("doc_id"), F.col("n_chars"), SEED)
    return rows.select("doc_id", F.md5(text.cast("binary")).alias("text_md5"))


def gen_random_words(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    text = synth.random_words_text(F.col("doc_id"), F.col("n_chars"), SEED)
    return rows.select("doc_id", F.md5(text.cast("binary")).alias("text_md5"))


# -- tokenization ------------------------------------------------------------


def corpus_vocabulary(spark, sf_dir):
    return _vocab(spark, sf_dir).tokens


def word_dictionary(spark, sf_dir):
    return dictionary.word_forms(split_words(_texts(spark, sf_dir).select("text")))


def whole_word_hits(spark, sf_dir):
    forms = word_dictionary(spark, sf_dir)
    return dictionary.whole_word_hits(forms, _vocab(spark, sf_dir))


def whole_word_misses(spark, sf_dir):
    forms = word_dictionary(spark, sf_dir)
    return dictionary.whole_word_misses(forms, _vocab(spark, sf_dir))


def greedy_segments(spark, sf_dir):
    words = dictionary.word_counts(split_words(_texts(spark, sf_dir).select("text")))
    cut = dictionary.segment_words(words, _vocab(spark, sf_dir))
    return cut.select(
        "word",
        "n_occ",
        F.concat_ws(" ", F.col("bare").cast("array<string>")).alias("bare"),
        F.concat_ws(" ", F.col("spaced").cast("array<string>")).alias("spaced"),
    )


def _greedy(spark, sf_dir, *more):
    return greedy_encode(_texts(spark, sf_dir, *more), _vocab(spark, sf_dir))


def greedy_bpe_encode(spark, sf_dir):
    return _joined(_greedy(spark, sf_dir))


def greedy_device_limits(spark, sf_dir):
    texts = _texts(spark, sf_dir).withColumn("cap", F.floor(F.octet_length("text") / 2))
    encoded = greedy_encode(
        texts,
        _vocab(spark, sf_dir),
        max_word_bytes=oracles.DEVICE_WORD,
        max_match_bytes=oracles.DEVICE_MATCH,
    )
    capped = encoded.withColumn(
        "token_ids", F.slice("token_ids", F.lit(1), F.col("cap").cast("int"))
    ).withColumn("n_tokens", F.size("token_ids"))
    return _joined(capped.drop("cap"))


def encode_conversations(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return _joined(greedy_encode(turns, _vocab(spark, sf_dir), ["conv_id", "turn"]))


def token_positions_query(spark, sf_dir):
    return token_positions(_greedy(spark, sf_dir)).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "token_id"
    )


def truncate_tokens_query(spark, sf_dir):
    return _joined(truncate_tokens(_greedy(spark, sf_dir), 512))


def padded_batches_query(spark, sf_dir):
    batches = padded_batches(_texts(spark, sf_dir), _vocab(spark, sf_dir), BATCH)
    return _joined(batches).withColumn("tail_bytes", F.col("tail_bytes").cast("long"))


def transfer_modes_query(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    return transfer_modes(texts, padded_batches(texts, _vocab(spark, sf_dir), BATCH))


def _hashed(spark, sf_dir, modulus):
    return _texts(spark, sf_dir).select(
        "doc_id", hash_tokens(F.col("text"), modulus).alias("token_ids")
    )


def hash_tokens_bpe(spark, sf_dir):
    return _joined(_hashed(spark, sf_dir, BPE_MODULUS))


def hash_tokens_wordpiece(spark, sf_dir):
    return _joined(_hashed(spark, sf_dir, WORDPIECE_MODULUS))


def _merged(spark, sf_dir):
    merges, vocab = _merges(spark, sf_dir)
    return merge_encode(_texts(spark, sf_dir), merges, vocab)


def merge_bpe_encode(spark, sf_dir):
    return _joined(_merged(spark, sf_dir))


def merge_rules_query(spark, sf_dir):
    return _merges(spark, sf_dir)[0].rules.select("token", "left_size", "rank")


def wordpiece_vocabulary(spark, sf_dir):
    return _wp_vocab(spark, sf_dir).tokens


def _wordpiece(spark, sf_dir, **options):
    return wordpiece_encode(_texts(spark, sf_dir), _wp_vocab(spark, sf_dir), **options)


def wordpiece_encode_query(spark, sf_dir):
    return _joined(_wordpiece(spark, sf_dir))


def wordpiece_capped(spark, sf_dir):
    return _joined(_wordpiece(spark, sf_dir, max_words=512, max_tokens=600))


def wordpiece_special(spark, sf_dir):
    return _joined(_wordpiece(spark, sf_dir, max_tokens=512, special_tokens=True))


def _decoded(spark, sf_dir, mode):
    vocab = _vocab(spark, sf_dir)
    return decode_tokens(_greedy(spark, sf_dir), vocab, mode=mode).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.md5(F.encode("text", "UTF-8")).alias("text_md5"),
    )


def decode_tokens_text(spark, sf_dir):
    return _decoded(spark, sf_dir, "text")


def decode_tokens_raw(spark, sf_dir):
    return _decoded(spark, sf_dir, "raw")


def token_counts(spark, sf_dir):
    return accounts.token_totals(_greedy(spark, sf_dir, "lang"), ["lang"])


def token_counts_by_label(spark, sf_dir):
    labels = _read(spark, sf_dir, "labels")
    texts = _texts(spark, sf_dir).join(labels.select("doc_id"), "doc_id", "left_semi")
    encoded = greedy_encode(texts, _vocab(spark, sf_dir))
    return accounts.token_totals(encoded.join(labels, "doc_id"), ["quality", "toxic"])


def tokenizer_comparison(spark, sf_dir):
    merges, merge_vocab = _merges(spark, sf_dir)
    vocab, pieces = _vocab(spark, sf_dir), _wp_vocab(spark, sf_dir)
    return compare_tokenizers(_texts(spark, sf_dir), vocab, merges, merge_vocab, pieces)


def payload_bytes(spark, sf_dir):
    """Tokens per text, and bytes as text and as IDs, by language and source."""
    texts = _texts(spark, sf_dir, "lang", "source").withColumn(
        "text_bytes", F.octet_length("text").cast("long")
    )
    encoded = greedy_encode(texts, _vocab(spark, sf_dir)).withColumn(
        "token_bytes", F.col("n_tokens").cast("long") * accounts.TOKEN_BYTES
    )
    return accounts.transfer_accounts(encoded, ["lang", "source"])


def _streamed(spark, sf_dir, schema, **options):
    documents = _read(spark, sf_dir, "documents")
    # a pattern stands for a file as well as for a folder of files
    stream = (
        spark.readStream.schema(documents.schema)
        .option("maxFilesPerTrigger", STREAM_FILES)
        .parquet(f"{sf_dir}/documents.parque[t]")
        .select("doc_id", "text")
    )
    out, state = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    # no input gives no batch: the output begins with an empty one
    spark.createDataFrame([], schema).write.parquet(f"{out}/batch=-1")
    query = encode_stream(stream, _vocab(spark, sf_dir), out, state, **options)
    query.awaitTermination()
    return _joined(spark.read.schema(schema).parquet(f"{out}/batch=*"))


def stream_encode(spark, sf_dir):
    return _streamed(spark, sf_dir, "doc_id bigint, token_ids array<int>, n_tokens int")


def stream_padded_batches(spark, sf_dir):
    schema = "doc_id bigint, batch_idx int, seq_len int, token_ids array<int>, cut_tokens int, tail_bytes int"
    batches = _streamed(spark, sf_dir, schema, batch_size=BATCH)
    return batches.withColumn("tail_bytes", F.col("tail_bytes").cast("long"))


def batch_sweep_query(spark, sf_dir):
    return batch_sweep(_texts(spark, sf_dir), oracles.SWEEP)


# -- embedding ---------------------------------------------------------------


def _tables(spark, sf_dir):
    """The supplied vectors as position and type table and, repeated over the
    vocabulary, as word table; rows 1 and 2 as scale and shift; the number of
    positions."""
    table = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = table.count()
    tokens = _vocab(spark, sf_dir).tokens.select("token_id", (F.col("token_id") % n).alias("vec_id"))
    word = tokens.join(table, "vec_id").select("token_id", "vec")
    pos = table.withColumnRenamed("vec_id", "pos")
    kind = table.withColumnRenamed("vec_id", "type_id").filter("type_id < 2")
    params = {r.vec_id: r.vec for r in table.filter("vec_id in (1, 2)").collect()}
    return word, pos, kind, params[1], params[2], n


def _checksum(rows, *keys):
    """Sums over the vectors of a text, rounded: order decides last digits."""
    sums = embed.vector_sums(rows, keys)
    return sums.withColumns({c: F.round(c, 3) + 0 for c in ("sum_all", "sum_first")})


def embedding_lookup(spark, sf_dir):
    word = _tables(spark, sf_dir)[0]
    return _checksum(
        embed.embedding_lookup(token_positions(_greedy(spark, sf_dir)), word), "doc_id"
    )


def embedding_sum(spark, sf_dir):
    word, pos, kind, _, _, n = _tables(spark, sf_dir)
    found = embed.embedding_lookup(token_positions(_greedy(spark, sf_dir)), word)
    return _checksum(embed.embedding_sum(found, pos, kind, F.lit(n)), "doc_id")


def embedding_affine_tanh(spark, sf_dir):
    word, _, _, gamma, beta, _ = _tables(spark, sf_dir)
    found = embed.embedding_lookup(token_positions(_greedy(spark, sf_dir)), word)
    return _checksum(embed.affine_tanh(found, gamma, beta), "doc_id")


def bert_embedding(spark, sf_dir):
    word, pos, kind, gamma, beta, n = _tables(spark, sf_dir)
    batches = padded_batches(_texts(spark, sf_dir), _vocab(spark, sf_dir), BATCH)
    tokens = token_positions(batches)
    # positions wrap at the sequence, or at the position table if it is shorter
    rows = embed.bert_embedding(
        tokens, word, pos, kind, gamma, beta, F.least(F.col("seq_len"), F.lit(n))
    )
    return _checksum(rows, "doc_id", "batch_idx")


# -- measurements ------------------------------------------------------------


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def skip_warmup(spark, sf_dir):
    return measures.skip_warmup(_events(spark, sf_dir), ["scenario"], "event_id", 3).select(
        "event_id", "scenario", "time_us"
    )


def latency_summary(spark, sf_dir):
    measured = measures.skip_warmup(
        _events(spark, sf_dir), ["scenario", "payload_kb"], "event_id", 3
    )
    stats = measures.latency_summary(measured, ["scenario", "payload_kb"], ["time_us"])
    return _rounded(stats, "time_us_mean", "time_us_std")


def latency_percentiles(spark, sf_dir):
    stats = measures.latency_percentiles(
        _events(spark, sf_dir), ["scenario", "payload_kb"], "time_us"
    )
    return _rounded(stats, "mean_us", "std_us", "p50", "p90", "p99")


def iteration_stats(spark, sf_dir):
    stats = measures.iteration_stats(_events(spark, sf_dir), ["scenario"], "time_us")
    return _rounded(stats, "mean_us", "std_us")


def unpivot_metrics(spark, sf_dir):
    names = {c: f"{c}_us" for c in EVENT_TYPES}
    return measures.unpivot_metrics(_wide_times(spark, sf_dir), ["user_id"], names)


def ab_saving(spark, sf_dir):
    mean = _exact_sum("time_us") / F.count("time_us")
    return measures.ab_saving(
        _events(spark, sf_dir), ["payload_kb"], "scenario", mean, "click", "view"
    )


def stage_sum(spark, sf_dir):
    wide = _wide_times(spark, sf_dir)
    return measures.stage_sum(wide, ["view", "click"], "total_us").select("user_id", "total_us")


def end_to_end_total(spark, sf_dir):
    return _rounded(
        measures.end_to_end_total(_stage_times(spark, sf_dir), ["payload_kb"]), "total_us"
    )


def stage_share(spark, sf_dir):
    shares = measures.stage_share(_stage_times(spark, sf_dir), ["payload_kb"])
    return _rounded(shares, "total_us", "share")


def throughput(spark, sf_dir):
    """Bytes and tokens of the texts over the times of the events of the same
    number."""
    times = _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), F.col("value").alias("time_us")
    )
    rows = (
        _greedy(spark, sf_dir, "lang")
        .join(_texts(spark, sf_dir), "doc_id")
        .join(times, "doc_id")
        .select(
            "lang",
            F.octet_length("text").cast("long").alias("bytes"),
            F.col("n_tokens").cast("long").alias("ids"),
            "time_us",
        )
    )
    rates = measures.throughput(rows, ["lang"], "bytes", "ids", "time_us")
    return _rounded(rates, "mb_per_s", "tokens_per_s", "total_us")


# -- files: written under the shared folder and read back ---------------------


def _one_text(value, spark: SparkSession, name: str) -> str:
    """Path of a file that holds one small text."""
    path = new_path(spark, name)
    value.coalesce(1).write.text(path)
    return path


def _lines(order: str, line: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line"))))
    return F.array_join(F.transform(rows, lambda r: r["line"]), "\n")


def bpe_vocabulary_file(spark, sf_dir):
    tokens = _vocab(spark, sf_dir).tokens
    entries = F.array_sort(F.collect_list(F.struct("token", "token_id")))
    value = tokens.agg(F.to_json(F.map_from_entries(entries)).alias("value"))
    return vocabularies.load_bpe_vocabulary(spark, _one_text(value, spark, "vocab-json"))


def merges_file(spark, sf_dir):
    lines = _lines("rank", F.concat_ws(" ", "left", "right"))
    value = _rules(spark, sf_dir).agg(F.concat(F.lit("#version: 0.2\n"), lines).alias("value"))
    return vocabularies.load_merges(spark, _one_text(value, spark, "merges-txt"))


def wordpiece_vocabulary_file(spark, sf_dir):
    value = _wp_vocab(spark, sf_dir).tokens.agg(_lines("token_id", F.col("token")).alias("value"))
    return vocabularies.load_wordpiece_vocabulary(spark, _one_text(value, spark, "vocab-txt"))


def greedy_from_file(spark, sf_dir):
    vocab = vocabulary(stored(bpe_vocabulary_file(spark, sf_dir), "file-vocab"))
    return _joined(greedy_encode(_texts(spark, sf_dir), vocab))


def merge_from_files(spark, sf_dir):
    rules = stored(merges_file(spark, sf_dir), "file-merges")
    vocab = vocabulary(stored(cv.merge_vocabulary(rules), "file-merge-vocab"))
    return _joined(merge_encode(_texts(spark, sf_dir), merge_rules(rules), vocab))


def measurement_files(spark, sf_dir):
    """Events, a third in each CSV shape, written to one folder and read into
    one table by the files' own headers."""
    events, folder = _events(spark, sf_dir), new_path(spark, "csv")
    time, number = F.col("time_us"), F.col("event_id")
    timed = (number % 100).cast("string")
    warm = F.when(number % 2 == 0, F.concat(F.lit("warmup"), number % 10)).otherwise(timed)
    values = {
        "scenario": F.col("scenario"),
        "payload_kb": F.col("payload_kb"),
        "iteration": warm,
        "run": number % 100,
        "gpu_util_pct": number % 50,
        "gpu_mem_mb": number % 500,
        "cpu_pct": number % 7,
    }
    for at, columns in enumerate(measurements.SHAPES.values()):
        cells = []
        for name, (common, kind) in columns.items():
            value = values.get(common, number % 1000 if kind == "int" else time)
            cells.append(value.cast(kind).alias(name))
        rows = events.filter(number % 3 == at).select(*cells)
        rows.write.mode("append").option("header", True).csv(folder)
    read = measurements.read_mixed_measurements(spark, folder)
    # a missing number is told apart from others alike in all engines
    return read.withColumns({c: F.col(c).cast("double") for c in ("gpu_mem_mb", "cpu_pct")})


def summary_file(spark, sf_dir):
    """Mean and deviation of every scenario under the three header lines."""
    stats = measures.latency_summary(_events(spark, sf_dir), ["scenario", "payload_kb"], ["time_us"])
    head = ",,TextGen_us,TextGen_us\n,,mean,std\nScenario,PayloadKB,,\n"
    part = {"mean": F.round("time_us_mean", 6), "std": F.round("time_us_std", 6)}
    part |= {"min": F.col("time_us_min"), "max": F.col("time_us_max")}
    cells = [
        F.coalesce(F.col(name) if name in stats.columns else part[name.rpartition("_")[2]], F.lit(""))
        for name in (field.split()[0] for field in measurements.SUMMARY_SCHEMA.split(", "))
    ]
    line = F.concat_ws(",", *[c.cast("string") for c in cells])
    rows = stats.select(F.concat_ws("/", "scenario", "payload_kb").alias("at"), line.alias("line"))
    value = rows.agg(F.concat(F.lit(head), _lines("at", F.col("line"))).alias("value"))
    return measurements.read_summary(spark, _one_text(value, spark, "summary"))


def log_markers(spark, sf_dir):
    """Every event as a log line between others; values by marker."""
    names = F.array(*[F.lit(m) for m in measurements.LOG_MARKERS])
    marker = F.get(names, (F.col("event_id") % len(measurements.LOG_MARKERS)).cast("int"))
    value = F.col("time_us").cast("decimal(18,2)").cast("string")
    line = F.concat(F.lit("[12:00] "), marker, F.lit(": "), value, F.lit(" us"))
    path = new_path(spark, "logs")
    lines = _events(spark, sf_dir).select(F.explode(F.array(line, F.lit("noise: 3"))).alias("value"))
    lines.write.text(path)
    found = measurements.read_log_markers(spark, path)
    return found.groupBy("marker").agg(
        F.count(F.lit(1)).alias("n"), _exact_sum("value").alias("total"), F.max("value").alias("most")
    )


def result_files(spark, sf_dir):
    """Nested results of every payload size, written as JSON and flattened."""
    stats = _rounded(
        measures.iteration_stats(_events(spark, sf_dir), ["payload_kb", "scenario"], "time_us"), "mean_us", "std_us"
    )
    rows = stats.select(
        "payload_kb",
        F.col("scenario").alias("tokenizer"),
        F.concat(F.lit("the "), "scenario").alias("name"),
        F.lit("host").alias("platform"),
        F.lit("table").alias("implementation"),
        "mean_us",
        "min_us",
        "max_us",
        "std_us",
        F.col("iterations").cast("int").alias("tokens"),
        F.col("iterations").cast("int").alias("iterations"),
        (F.col("payload_kb") * 1024).alias("text_bytes"),
    )
    path = new_path(spark, "results")
    nested = measurements.nest_results(rows).repartition(RESULT_FILES, "payload_kb")
    nested.write.option("maxRecordsPerFile", 1).json(path)
    return measurements.explode_results(measurements.read_results(spark, path))


def transfer_files(spark, sf_dir):
    """Both modes written by key and read back: what each row holds."""
    texts, path = _texts(spark, sf_dir), new_path(spark, "transfer")
    batches = padded_batches(texts, _vocab(spark, sf_dir), BATCH)
    sinks.write_transfer(path, texts, batches, key="doc_id")
    ids = _joined(layout.read_keyed(spark, f"{path}/mode=A", "doc_id"))
    sent = layout.read_keyed(spark, f"{path}/mode=B", "doc_id")
    return ids.select(
        F.lit("A").alias("mode"), "doc_id", "batch_idx", F.md5(F.col("token_ids").cast("binary")).alias("content_md5")
    ).unionByName(
        sent.select(
            F.lit("B").alias("mode"),
            "doc_id",
            F.lit(-1).alias("batch_idx"),
            F.md5(F.encode("text", "UTF-8")).alias("content_md5"),
        )
    )


def statistics_file(spark, sf_dir):
    stats = measures.latency_percentiles(_events(spark, sf_dir), ["scenario", "payload_kb"], "time_us")
    path = new_path(spark, "statistics")
    sinks.write_statistics(stats, path, 6)
    return spark.read.schema(stats.schema).option("header", True).csv(path)


def metric_percentiles(spark, sf_dir):
    """Statistics of several metrics at once, in long form."""
    names = {c: f"{c}_us" for c in EVENT_TYPES}
    long = measures.unpivot_metrics(_wide_times(spark, sf_dir), ["user_id"], names)
    stats = measures.latency_percentiles(long, ["metric"], "value")
    return _rounded(stats, "mean_us", "std_us", "p50", "p90", "p99")


def speedup_vs_slowest(spark, sf_dir):
    return ranking.speedup_vs_slowest(_platform_times(spark, sf_dir), "algo")


def speedup_vs_baseline(spark, sf_dir):
    return ranking.speedup_vs_baseline(_platform_times(spark, sf_dir), "algo", "platform", "p0")


def platform_rank(spark, sf_dir):
    ranked = ranking.platform_rank(_platform_times(spark, sf_dir), "algo", "platform")
    return ranking.fastest_first(ranked, "time_us", "algo", "platform")


def best_platform(spark, sf_dir):
    return ranking.best_platform(_platform_times(spark, sf_dir), "algo", "platform")


def stage_timeline(spark, sf_dir):
    times = ranking.stage_timeline(_stage_times(spark, sf_dir), ["payload_kb"], F.col("stage"))
    return _rounded(times, "start_us", "end_us")


# -- contract ----------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Tokens and bytes per language and source on the smallest tables."""
    return payload_bytes(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "scan_payloads": scan_payloads,
        "byte_alphabet": byte_alphabet,
        "byte_round_trip": byte_round_trip,
        "word_split": word_split,
        "pre_tokens": pre_tokens,
        "wordpiece_normalize": wordpiece_normalize,
        "basic_token_counts": basic_token_counts,
        "batch_slices": batch_slices,
        "payload_clamp": payload_clamp,
        "gen_pattern_text": gen_pattern_text,
        "gen_random_text": gen_random_text,
        "gen_random_words": gen_random_words,
        "corpus_vocabulary": corpus_vocabulary,
        "word_dictionary": word_dictionary,
        "whole_word_hits": whole_word_hits,
        "whole_word_misses": whole_word_misses,
        "greedy_segments": greedy_segments,
        "greedy_bpe_encode": greedy_bpe_encode,
        "greedy_device_limits": greedy_device_limits,
        "encode_conversations": encode_conversations,
        "token_positions": token_positions_query,
        "truncate_tokens": truncate_tokens_query,
        "padded_batches": padded_batches_query,
        "transfer_modes": transfer_modes_query,
        "hash_tokens": hash_tokens_bpe,
        "hash_tokens_wordpiece": hash_tokens_wordpiece,
        "merge_rules": merge_rules_query,
        "merge_bpe_encode": merge_bpe_encode,
        "wordpiece_vocabulary": wordpiece_vocabulary,
        "wordpiece_encode": wordpiece_encode_query,
        "wordpiece_capped": wordpiece_capped,
        "wordpiece_special": wordpiece_special,
        "decode_tokens": decode_tokens_text,
        "decode_tokens_raw": decode_tokens_raw,
        "token_counts": token_counts,
        "token_counts_by_label": token_counts_by_label,
        "tokenizer_comparison": tokenizer_comparison,
        "payload_bytes": payload_bytes,
        "stream_encode": stream_encode,
        "stream_padded_batches": stream_padded_batches,
        "batch_sweep": batch_sweep_query,
        "embedding_lookup": embedding_lookup,
        "embedding_sum": embedding_sum,
        "embedding_affine_tanh": embedding_affine_tanh,
        "bert_embedding": bert_embedding,
        "skip_warmup": skip_warmup,
        "latency_summary": latency_summary,
        "latency_percentiles": latency_percentiles,
        "iteration_stats": iteration_stats,
        "unpivot_metrics": unpivot_metrics,
        "ab_saving": ab_saving,
        "stage_sum": stage_sum,
        "end_to_end_total": end_to_end_total,
        "stage_share": stage_share,
        "throughput": throughput,
        "speedup_vs_slowest": speedup_vs_slowest,
        "speedup_vs_baseline": speedup_vs_baseline,
        "platform_rank": platform_rank,
        "best_platform": best_platform,
        "stage_timeline": stage_timeline,
        "bpe_vocabulary_file": bpe_vocabulary_file,
        "merges_file": merges_file,
        "wordpiece_vocabulary_file": wordpiece_vocabulary_file,
        "greedy_from_file": greedy_from_file,
        "merge_from_files": merge_from_files,
        "measurement_files": measurement_files,
        "summary_file": summary_file,
        "log_markers": log_markers,
        "result_files": result_files,
        "transfer_files": transfer_files,
        "statistics_file": statistics_file,
        "metric_percentiles": metric_percentiles,
    }
    if llm:
        found |= llm.QUERIES
    if corpus_pipeline:
        found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: oracles.statement(sql) for name, sql in oracles.QUERIES.items()}
    if llm:
        found |= llm.ORACLES
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
