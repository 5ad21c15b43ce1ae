import random
import struct
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from tokenmill.llm import idfiles

PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def theirs():
    tokenizer = Tokenizer.from_file(PATH)  # as it is: strings of special tokens are those
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("top", [0, 1, 200, 50_000, 2**32 - 1])
@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_blocks_come_back(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 100, n, dtype=np.uint64) if n else np.zeros(0, np.uint64)
    ids[::37] = top  # outliers
    data = idfiles.file_bytes(2, 3, [7], [ids.astype("<u4").tobytes()])
    part, number, doc_ids, null, lengths, back = idfiles.read_file(data)
    assert (part, number, doc_ids.tolist(), null.tolist(), lengths.tolist()) == (2, 3, [7], [0], [n])
    assert back.tolist() == ids.tolist()


def test_outliers_do_not_widen_blocks():
    ids = np.arange(256, dtype=np.uint32) % 16
    ids[[3, 77]] = 40_000
    blocks, lows, widths, counts = idfiles.pack_blocks(ids)
    assert (lows.tolist(), widths.tolist(), counts.tolist()) == ([0], [4], [2])
    assert len(blocks[0]) == 256 * 4 // 8 + 2 * (2 + 4)


def test_a_block_alone_by_the_index():
    ids = np.random.default_rng(1).integers(0, 9000, 2560).astype(np.uint32)
    blocks, lows, widths, counts = idfiles.pack_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    one = idfiles.unpack_blocks(b"".join(blocks), starts[4:5], lows[4:5], widths[4:5], counts[4:5])
    assert one[0].tolist() == ids[1024:1280].tolist()


def test_words_like_the_library(theirs):
    with open(PATH, encoding="utf-8") as file:
        mine = idfiles.word_encoder(file.read())
    texts = [f"{chr(c)}a{chr(c)} x{chr(c)}{chr(c)}" for c in range(1, 0x500)]
    texts += ["It's WE'LL don't", "<|endoftext|> a<|startoftext|>", "á ȩ́", "İI ẞ", "", " \n "]
    for text in texts:
        assert memoryview(mine(text)).cast("I").tolist() == theirs(text), text


def test_special_tokens_like_the_library(theirs):
    with open(PATH, encoding="utf-8") as file:
        mine = idfiles.word_encoder(file.read())
    texts = ["<|endoftext|>", "x<|endoftext|>y", "<|startoftext|><|endoftext|>", "a <|endoftext", "<|ENDOFTEXT|>", "É<|endoftext|>日"]
    assert theirs(texts[1])[1] == 49407
    for text, ids in zip(texts, mine.encode(texts)):
        assert memoryview(ids).cast("I").tolist() == theirs(text), text


def test_words_of_a_batch_like_the_library(theirs, monkeypatch):
    """Many different words, more than are kept from batch to batch."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèàçñøœıƒ"
    texts = []
    for _ in range(60):
        some = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(120)]
        texts.append(" ".join(w.upper() if rng.random() < 0.2 else w + rng.choice(["", ",", "'s", "9", "\t", "中"]) for w in some))
    texts.append("ab" * 40_000)
    monkeypatch.setattr(idfiles.WordEncoder, "LIMIT", 1000)
    with open(PATH, encoding="utf-8") as file:
        mine = idfiles.WordEncoder(file.read())
    assert mine.plain
    for start in range(0, len(texts), 7):
        for text, ids in zip(texts[start : start + 7], mine.encode(texts[start : start + 7])):
            assert memoryview(ids).cast("I").tolist() == theirs(text)
        assert len(mine.known) <= 1000


def test_other_tokenizers_go_through_the_library():
    path = public.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        mine = idfiles.WordEncoder(file.read())
    assert not mine.plain
    known = Tokenizer.from_file(path)
    assert memoryview(mine.by_library("a piece")).cast("I").tolist() == known.encode("a piece").ids


@pytest.mark.parametrize("file_ids", [idfiles.FILE_IDS, 500])
def test_digests_of_written_files(odd, odd_rows, theirs, file_ids):
    rows = idfiles.id_digests(odd, PATH, 2, file_ids=file_ids).collect()
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows)
    assert len(got) == len(odd_rows)
    at, by_id = 0, {}
    for doc_id, text, *_ in odd_rows:
        by_id.setdefault(doc_id, []).append([*theirs(text or ""), 2])
    last = None
    for start, doc_id, n, crc in got:
        ids = next(i for i in by_id[doc_id] if (len(i), zlib.crc32(struct.pack(f"<{len(i)}I", *i))) == (n, crc))
        by_id[doc_id].remove(ids)
        assert start == at and (last is None or doc_id >= last)
        at, last = at + n, doc_id
    assert got[0][1] is None


def test_ids_read_back(odd, theirs, tmp_path):
    path = str(tmp_path / "files")
    idfiles.write_id_files(odd, path, PATH, 2)
    read = idfiles.read_id_files(odd.sparkSession, path).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in read:
        if r["doc_id"] not in (8, 9):
            assert r["ids"] == [*theirs(texts[r["doc_id"]] or ""), 2]


def test_empty_table(none):
    assert idfiles.id_digests(none, PATH, 2).collect() == []
