import hashlib
import random

import public_tokenizers as public
import pytest
import tiktoken

from tokenmill.llm import bpe

RANKS = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def mine():
    with open(RANKS, "rb") as file:
        return bpe.bpe(file.read(), public.PATTERN)


@pytest.fixture(scope="module")
def theirs(mine):
    return tiktoken.Encoding(
        "own", pat_str=public.PATTERN, mergeable_ranks=mine.ranks, special_tokens={}
    )


def ids(data):
    return memoryview(data).cast("i").tolist()


def test_texts_like_the_library(mine, theirs):
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "1", "23", "'s", "é", "!", "%%%", "\t", "日", "😀", " ", "\x1c", "ing"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert ids(mine.encode(text)) == theirs.encode_ordinary(text)


def test_tree_and_direct_merges_agree(mine):
    rng = random.Random(2)
    for letters in ("ab", "abcdefgh", "=-", "the ", "日é"):
        for _ in range(40):
            data = "".join(rng.choice(letters) for _ in range(rng.randint(1, 300))).encode()
            assert mine.tree(data) == mine._merge_long(data)
            if len(data) <= 4 * bpe.LEAF:
                assert mine.merge(data) == mine._merge_long(data)


def test_join_is_the_product_at_any_cut(mine):
    rng = random.Random(3)
    data = "".join(rng.choice("abcdeth") for _ in range(200)).encode()
    whole = mine._merge_long(data)
    for cut in range(len(data) + 1):
        assert mine.join(mine._merge_long(data[:cut]), mine._merge_long(data[cut:])) == whole


def test_long_match(mine, theirs):
    text = "".join(random.Random(4).choice("abcdefghij") for _ in range(50_000))
    assert ids(mine.encode(text)) == theirs.encode_ordinary(text)


def test_frame_round_trip(odd, odd_rows, theirs):
    rows = bpe.decode_ids(bpe.encode_texts(odd, RANKS, public.PATTERN, keep=("doc_id", "text")), RANKS).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r["ids"] == theirs.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_empty_table(none):
    assert bpe.decode_ids(bpe.encode_texts(none, RANKS, public.PATTERN), RANKS).collect() == []


def test_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="not in the vocabulary|out of bounds"):
        bpe.decode_ids(spark.createDataFrame([([50_256],)], "ids array<int>"), RANKS).collect()


def test_query_on_whole_table(spark, theirs):
    from tokenmill.llm import queries

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_byte_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = theirs.encode_ordinary(texts[r["doc_id"]])
        digest = hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), digest)
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
