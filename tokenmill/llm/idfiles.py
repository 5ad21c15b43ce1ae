"""Token ids in files of patched frame-of-reference blocks.

A file holds whole documents in order. All numbers are little-endian:

    magic "PFR1"
    blocks     each: packed values, exception places (u16), exceptions (u32)
    documents  doc_id (i64), null flag (u8), number of ids (u32); column by column
    index      for each block: start (u64), minimum (u32), width (u8), number
               of exceptions (u16); column by column
    footer     part, file of the part, documents, ids, blocks (5 x u64),
               start of the document table (u64), magic "PFR1"

A block holds BLOCK ids (the last one is filled with its minimum): the block's
minimum is subtracted, the differences are packed at the width that
``PERCENTILE`` of them need, and those that need more are stored whole as
exceptions; their packed place holds 0. With the index any block can be read
alone.

The files are written by Spark's own writer, so its commit protocol removes
what lost tasks leave: one row holds one file, and the text writer puts one row
into each file and ends it with a line feed, which is not part of the format.
Files are ordered by the part and file numbers in their footers.

Documents are ordered by id, null first, equal ids by the hash of the text; the
order is a range exchange, so no task holds more than its range. A file closes
once it holds ``file_ids`` ids: its size is bounded by that and one document.
"""

from __future__ import annotations

import array
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenmill.functions.bytelevel import byte_symbols
from tokenmill.llm.common import sub_batches, texts_of
from tokenmill.scratch import new_path, stored

MAGIC = b"PFR1"
BLOCK = 256
PERCENTILE = 90
FILE_IDS = 8 << 20
CHUNK = 4096  # blocks that are packed at once
BATCH = 4 << 20  # bytes of text that are encoded together
FOOTER = struct.Struct("<6Q4s")


# -- blocks ------------------------------------------------------------------


def _holder(width: int) -> tuple[str, int]:
    """Big-endian type that holds the width, and its bits."""
    return next((f">u{b}", 8 * b) for b in (1, 2, 4) if width <= 8 * b)


def pack_blocks(ids: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, minimum, width and number of exceptions of each block."""
    blocks, lows, widths, counts = [], [], [], []
    for start in range(0, len(ids), BLOCK * CHUNK):
        part = ids[start : start + BLOCK * CHUNK]
        if len(part) % BLOCK:
            tail = part[len(part) - len(part) % BLOCK :]
            fill = np.full(BLOCK - len(tail), tail.min(), dtype=part.dtype)
            part = np.concatenate([part, fill])
        rows = part.reshape(-1, BLOCK).astype(np.uint32)
        low = rows.min(axis=1)
        rows = rows - low[:, None]
        place = BLOCK * PERCENTILE // 100 - 1
        common = np.partition(rows, place, axis=1)[:, place]
        # frexp gives the number of bits of a whole number
        width = np.frexp(common.astype(np.float64))[1].astype(np.uint8)
        odd = rows >= (np.uint64(1) << width.astype(np.uint64))[:, None]
        count = odd.sum(axis=1).astype(np.uint16)
        packed: list[bytes] = [b""] * len(rows)
        kept = np.where(odd, 0, rows).astype(np.uint32)
        for w in np.unique(width).tolist():
            if w:
                same = np.flatnonzero(width == w)
                kind, size = _holder(w)
                bits = np.unpackbits(kept[same].astype(kind).view(np.uint8), axis=1)
                bits = bits.reshape(len(same), BLOCK, size)[:, :, size - w :]
                body = np.packbits(bits.reshape(len(same), -1), axis=1)
                for i, data in zip(same, body):
                    packed[i] = data.tobytes()
        places = np.nonzero(odd)[1].astype("<u2").tobytes()
        whole = rows[odd].astype("<u4").tobytes()
        end = 0
        for i, n in enumerate(count.tolist()):
            if n:
                packed[i] += places[2 * end : 2 * (end + n)] + whole[4 * end : 4 * (end + n)]
                end += n
        blocks += packed
        lows.append(low)
        widths.append(width)
        counts.append(count)
    if not blocks:
        none = np.zeros(0, dtype=np.uint32)
        return [], none, none.astype(np.uint8), none.astype(np.uint16)
    return blocks, np.concatenate(lows), np.concatenate(widths), np.concatenate(counts)


def unpack_blocks(
    data: bytes, starts: np.ndarray, lows: np.ndarray, widths: np.ndarray, counts: np.ndarray
) -> np.ndarray:
    """The ids of the blocks, BLOCK for each."""
    out = np.empty((len(starts), BLOCK), dtype=np.uint32)
    raw = np.frombuffer(data, dtype=np.uint8)
    for w in np.unique(widths).tolist():
        same = np.flatnonzero(widths == w)
        for at in range(0, len(same), CHUNK):
            some = same[at : at + CHUNK]
            if not w:
                out[some] = 0
                continue
            size = BLOCK * w // 8
            body = raw[starts[some].astype(np.int64)[:, None] + np.arange(size)]
            kind, wide = _holder(w)
            bits = np.zeros((len(some), BLOCK, wide), dtype=np.uint8)
            bits[:, :, wide - w :] = np.unpackbits(body, axis=1).reshape(len(some), BLOCK, w)
            out[some] = np.packbits(bits.reshape(len(some), -1), axis=1).view(kind)
    n = counts.astype(np.int64)
    block = np.repeat(np.arange(len(starts)), n)
    number = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
    body = starts.astype(np.int64) + BLOCK * widths.astype(np.int64) // 8
    places = raw[(body[block] + 2 * number)[:, None] + np.arange(2)].view("<u2").reshape(-1)
    whole = raw[((body + 2 * n)[block] + 4 * number)[:, None] + np.arange(4)].view("<u4").reshape(-1)
    out[block, places] = whole
    return out + lows[:, None]


# -- files -------------------------------------------------------------------


def file_bytes(part: int, number: int, doc_ids: list, ids: list[bytes]) -> bytes:
    """A file of documents; ``ids`` holds each one's ids as uint32."""
    values = np.frombuffer(b"".join(ids), dtype="<u4")
    blocks, lows, widths, counts = pack_blocks(values)
    sizes = np.array([len(b) for b in blocks], dtype=np.int64)
    starts = len(MAGIC) + np.cumsum(sizes) - sizes
    body = MAGIC + b"".join(blocks)
    known = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    lengths = np.array([len(x) // 4 for x in ids], dtype="<u4")
    tables = [known, null, lengths, starts.astype("<u8"), lows.astype("<u4"), widths, counts.astype("<u2")]
    footer = FOOTER.pack(part, number, len(doc_ids), len(values), len(blocks), len(body), MAGIC)
    return body + b"".join(t.tobytes() for t in tables) + footer


def read_file(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Part, number, doc_ids, null flags, lengths and ids of a file."""
    if data[:4] != MAGIC or data[-4:] != MAGIC:
        raise ValueError("no file of patched frame-of-reference blocks")
    part, number, n_docs, n_ids, n_blocks, at, _ = FOOTER.unpack(data[-FOOTER.size :])
    columns = []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u8", n_blocks), ("<u4", n_blocks), ("u1", n_blocks), ("<u2", n_blocks)):
        columns.append(np.frombuffer(data, kind, n, at))
        at += columns[-1].nbytes
    doc_ids, null, lengths, *index = columns
    ids = unpack_blocks(data, *index).reshape(-1)[:n_ids]
    return part, number, doc_ids, null, lengths, ids


# -- tokens ------------------------------------------------------------------

class WordEncoder:
    """Ids of whole texts by the tokenizers library, for tokenizers that drop
    white space and never join across it. The different words of a batch that
    are not known yet are encoded together.

    The library normalises with a map of places, which costs more than the
    merges. In a text of ASCII and letters below U+0250 lower case is all that
    its normaliser does (composed forms stay as they are), so such a text is
    split here; of others, each piece between blanks and line feeds that is not
    so simple goes through the library. Words are merged by the tiktoken library: the last byte of a
    word, which the vocabulary marks as a word's end, is given as another byte
    that no word has (a capital, or one below 64). The patterns are tied to the
    tokenizer's normaliser, splitter and the order of its merges, which are
    compared; with others every piece takes the long way.

    The strings of special tokens inside texts are those tokens, which is the
    library's default.
    """

    # fixed values
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    END = "</w>"
    LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ƿǄ-ȹȻ-Ƚȿ-ɏ"  # without U+0130, U+023A and U+023E
    LOWERED = LETTERS + "ɐ-ʯ"  # of some, the lower case is beyond U+024F
    PLAIN = re.compile(f"[{LOWERED}]+")
    SIMPLE = re.compile(f"[ \\n!-~{LETTERS}]*")
    MATCH = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LOWERED}]+|[0-9]|[^0-9{LOWERED} \\n]+")
    LIMIT = 400_000  # words that are kept from batch to batch
    LONGEST = 64  # letters of those

    def __init__(self, data: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        settings = json.loads(data)
        self.special = {t["content"]: array.array("I", [t["id"]]).tobytes() for t in settings["added_tokens"]}
        self.special_parts = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        model = settings["model"]
        steps = [n["type"] for n in (settings["normalizer"] or {}).get("normalizers", [])]
        split = (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {})
        made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        self.plain = (
            steps == self.NORMALIZERS
            and split.get("Regex") == self.SPLIT
            and model["end_of_word_suffix"] == self.END
            and made == list(range(512, 512 + len(made)))
        )
        if self.plain:
            self._words(model["vocab"])
        self.known = dict(self.special)

    def _words(self, vocab: dict[str, int]) -> None:
        """The vocabulary of lower-case words, with marked ends."""
        import tiktoken

        byte = {symbol: b for b, symbol in enumerate(byte_symbols())}
        inner = {*range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCB)}
        ranks = {}
        for token, number in vocab.items():
            ends = token.endswith(self.END)
            name = bytes(byte.get(c, 0) for c in token.removesuffix(self.END))
            if name and inner.issuperset(name) and not (ends and name[-1] >= 0xC0):
                ranks[self.marked(name) if ends else name] = number
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in ranks.items() if t[-1] < 64 or 65 <= t[-1] <= 90]] = True
        words = tiktoken.Encoding("words", pat_str="[a-z]*[A-Z]", mergeable_ranks=ranks, special_tokens={})
        self.joined = words.encode_to_numpy
        self.one = words._core_bpe.encode_single_piece

    @staticmethod
    def marked(word: bytes) -> bytes:
        last = word[-1]
        return word[:-1] + bytes([last - 32 if last < 0x80 else last - 0x80])

    def by_library(self, piece: str) -> bytes:
        return array.array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of lower-case words; those of a-z all at once."""
        found = {}
        ascii_ = [w for w in words if w.isascii()]
        ids = self.joined(" ".join([w[:-1] + w[-1].upper() for w in ascii_]))
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        raw, start = ids.astype("<u4").tobytes(), 0
        for word, end in zip(ascii_, ends.tolist()):
            found[word] = raw[start:end]
            start = end
        for word in words:
            if word not in found:
                found[word] = array.array("I", self.one(self.marked(word.encode()))).tobytes()
        return found

    def learn(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of parts that are not known."""
        found = self.encode_words([p for p in parts if self.PLAIN.fullmatch(p)]) if self.plain else {}
        return found | {p: self.by_library(p) for p in parts.difference(found)}

    def split(self, text: str) -> list[str]:
        """The words and marks of a text, and whole pieces that are not simple."""
        if self.plain and self.SIMPLE.fullmatch(text):
            return self.MATCH.findall(text.lower())
        parts = []
        for piece in text.replace("\n", " ").split(" "):
            if self.plain and self.SIMPLE.fullmatch(piece):
                parts += self.MATCH.findall(piece.lower())
            else:
                parts.append(piece)
        return parts

    def parts_of(self, text: str) -> list[str]:
        """Parts and strings of special tokens; a part is never such a string."""
        if not self.special_parts.search(text):
            return self.split(text)
        parts, at = [], 0
        for match in self.special_parts.finditer(text):
            parts += [*self.split(text[at : match.start()]), match[0]]
            at = match.end()
        return parts + self.split(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit integers."""
        rows = [self.parts_of(t) for t in texts]
        parts = set().union(*rows)
        if len(self.known) + len(parts) > self.LIMIT:
            self.known = dict(self.special)
        missing = self.learn(parts.difference(self.known))
        self.known |= missing
        out = [b"".join(map(self.known.__getitem__, row)) for row in rows]
        if len(self.known) > self.LIMIT:
            self.known = dict(self.special)
        for part in missing:
            if len(part) > self.LONGEST:
                self.known.pop(part, None)
        return out

    def __call__(self, text: str) -> bytes:
        return self.encode([text])[0]


_encoders: dict[int, WordEncoder] = {}


def word_encoder(data: str) -> WordEncoder:
    """One for each process."""
    key = zlib.crc32(data.encode())
    if key not in _encoders:
        _encoders[key] = WordEncoder(data)
    return _encoders[key]


# -- jobs --------------------------------------------------------------------


def write_id_files(
    df: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_ids: int = FILE_IDS,
) -> None:
    """Encodes every text, appends ``end_id`` and writes the files to ``path``.
    A null text counts as empty. Other columns are not read."""
    with open(tokenizer_path, encoding="utf-8") as file:
        data = file.read()
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(data), TaskContext.get().partitionId()
        number, held, doc_ids, ids = 0, 0, [], []

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"file": pa.array([file_bytes(part, number, doc_ids, ids)], pa.binary())}
            )

        for batch in sub_batches(batches, "_text", BATCH):
            texts = texts_of(batch.column("_text"))
            for doc_id, one in zip(batch.column("_id").to_pylist(), encoder.encode(texts)):
                doc_ids.append(doc_id)
                ids.append(one + end)
                held += len(one) // 4 + 1
                if held >= file_ids:
                    yield closed()
                    number, held, doc_ids, ids = number + 1, 0, [], []
        if doc_ids:
            yield closed()

    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text"), F.col("_text")]
    (
        rows.repartitionByRange(*order[:2])
        .sortWithinPartitions(*order)
        .mapInArrow(run, "file binary")
        .select(F.col("file").cast("string"))  # the bytes as they are
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )


def read_id_files(spark: SparkSession, path: str) -> DataFrame:
    """part, file, place in the file, doc_id, ids (array of long), from the
    files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in _contents(batches):
            part, number, doc_ids, null, lengths, ids = read_file(data)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            n = len(doc_ids)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(np.full(n, part)),
                    "file": pa.array(np.full(n, number)),
                    "place": pa.array(np.arange(n)),
                    "doc_id": pa.array(doc_ids, mask=null.astype(bool)),
                    "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int64))),
                }
            )

    schema = "part long, file long, place long, doc_id long, ids array<long>"
    return _files(spark, path).mapInArrow(run, schema)


def read_id_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files;
    start counts the ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in _contents(batches):
            part, number, doc_ids, null, lengths, ids = read_file(data)
            raw, n = memoryview(ids.astype("<u4").tobytes()), len(doc_ids)
            ends = np.cumsum(lengths.astype(np.int64))
            begins = ends - lengths
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(np.full(n, part)),
                    "file": pa.array(np.full(n, number)),
                    "doc_id": pa.array(doc_ids, mask=null.astype(bool)),
                    "begin": pa.array(begins),
                    "n_tokens": pa.array(lengths.astype(np.int64)),
                    "ids_crc32": pa.array(crcs, pa.int64()),
                }
            )

    schema = "part long, file long, doc_id long, begin long, n_tokens long, ids_crc32 long"
    rows = stored(_files(spark, path).mapInArrow(run, schema), "id-digests")
    files = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    # one row for each part of the written table, then one for each of its files
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("of_part"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", "file", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("of_file"))
    starts = files.join(parts, "part").select(
        "part", "file", (F.col("of_part") + F.col("of_file")).alias("base")
    )
    return rows.join(starts, ["part", "file"]).select(
        "doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """Files without the writer's line feed; empty ones come from tasks
    without rows."""
    for batch in batches:
        for value in batch.column("content"):
            data = value.as_py()
            if data:
                yield data[:-1]


def id_digests(df: DataFrame, tokenizer_path: str, end_id: int, **options) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    spark = df.sparkSession
    path = new_path(spark, "id-files")
    write_id_files(df, path, tokenizer_path, end_id, **options)
    return read_id_digests(spark, path)
