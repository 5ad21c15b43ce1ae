"""Tokenizing texts as they arrive."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenmill.functions.shape import batch_slices
from tokenmill.functions.words import split_words
from tokenmill.operators.dictionary import Dictionary, segment_words, store_dictionary, word_counts
from tokenmill.operators.greedy import greedy_encode
from tokenmill.operators.vocabulary import Vocabulary
from tokenmill.plans.batches import padded_batches
from tokenmill.scratch import stored, temporary_tables

WORDS = "word string, bare array<int>, spaced array<int>"


class WordTable:
    """The words that a stream has met, with their tokens: a folder to which
    each micro-batch adds the words that are new in it.

    A batch reads what the batches before it left and replaces its own part, so
    a batch that is run again finds the same state.
    """

    def __init__(self, spark: SparkSession, path: str, vocab: Vocabulary, byte_view: bool) -> None:
        # tokens belong to a vocabulary; another one begins a table of its own
        mark = zlib.crc32(repr(sorted(vocab.mapping.items())).encode())
        self.path = f"{path}/{'slices' if byte_view else 'words'}-{mark:08x}"
        self.vocab, self.byte_view = vocab, byte_view
        spark.createDataFrame([], WORDS).write.mode("ignore").parquet(f"{self.path}/batch=-1")

    def dictionary(self, words: DataFrame, batch_id: int) -> Dictionary:
        """The dictionary of the words of a batch; only new ones are cut."""
        spark = words.sparkSession
        counts = stored(word_counts(words), "stream-words")
        table = spark.read.schema(f"{WORDS}, batch long").option("basePath", self.path)
        known = table.parquet(f"{self.path}/batch=*").where(F.col("batch") < batch_id).drop("batch")
        new = segment_words(counts.select("word").join(known, "word", "left_anti"), self.vocab, self.byte_view)
        mine = f"{self.path}/batch={batch_id}"
        new.write.mode("overwrite").parquet(mine)
        every = known.unionByName(spark.read.schema(WORDS).parquet(mine))
        size = F.octet_length("word") + 4 * F.size("bare") + 4 * F.size("spaced") + 32
        return store_dictionary(counts.join(every, "word"), size, "greedy-words")


def encode_stream(
    texts: DataFrame,
    vocab: Vocabulary,
    out_path: str,
    checkpoint: str,
    keys: Sequence[str] = ("doc_id",),
    batch_size: int | None = None,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Token rows of a stream of texts as parquet under ``out_path``.

    Each micro-batch replaces its own folder, so a repeated batch leaves no
    duplicates; the tables it stores on the way are deleted with it. Words that
    an earlier batch met are not cut again: they stay in a table beside the
    checkpoint (``<checkpoint>-words``). ``batch_size`` asks for padded batches
    instead of whole token sequences. Without a ``trigger`` the query stops when
    all present input is read. How much a micro-batch reads is up to the source
    (``maxFilesPerTrigger``).
    """
    known = WordTable(texts.sparkSession, f"{checkpoint}-words", vocab, batch_size is not None)

    def encode(batch: DataFrame, batch_id: int) -> DataFrame:
        if batch_size is None:
            words = known.dictionary(split_words(batch.select("text")), batch_id)
            return greedy_encode(batch, vocab, keys, words)
        slices = batch_slices(batch.select(*keys, "text"), batch_size)
        words = known.dictionary(split_words(slices.select("text")), batch_id)
        return padded_batches(batch, vocab, batch_size, keys, words)

    return (
        texts.writeStream.foreachBatch(_writer(encode, out_path))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _writer(
    encode: Callable[[DataFrame, int], DataFrame], out_path: str
) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        # the dictionary and the texts both read the batch from its files
        with temporary_tables(batch.sparkSession):
            encode(batch, batch_id).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return write
