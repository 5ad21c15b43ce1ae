import pytest

from tokenmill.functions.words import split_chunks
from tokenmill.operators.vocabulary import vocabulary
from tokenmill.operators.wordpiece import wordpiece_encode
from tokenmill.plans.corpus_vocabulary import wordpiece_vocabulary
from tokenmill.scratch import stored

tokenizers = pytest.importorskip("tokenizers")

EDGE = [
    "für Ünïcode 한국어 텍스트 中文字符 x😀y ＡＢ Σας ΣΑΣ İstanbul é a​b",
    "$5+3=<8> `q` “quoted” — dash naïve—test…",
    "a" * 100 + " " + "b" * 101,
    "\x07bell\x85x a�b c　d",
    "Å Ω ﬁ ½ ǆ 가 각 힣",
    "",
    " \n\t ",
]


def library(tokens):
    made = tokenizers.Tokenizer(
        tokenizers.models.WordPiece(vocab=tokens, unk_token="[UNK]", max_input_chars_per_word=100)
    )
    made.normalizer = tokenizers.normalizers.BertNormalizer(lowercase=True)
    made.pre_tokenizer = tokenizers.pre_tokenizers.BertPreTokenizer()
    return made


@pytest.fixture(scope="module")
def vocab(spark, docs):
    chunks = split_chunks(docs.select("text"))
    return vocabulary(stored(wordpiece_vocabulary(chunks, 800, 600), "test-wp"))


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def test_documents_match_library(spark, docs, vocab):
    made = library({r.token: r.token_id for r in vocab.tokens.collect()})
    want = {r.doc_id: made.encode(r.text).ids for r in docs.collect()}
    for bounds in ({}, {"hot_rows": 30}):
        got = wordpiece_encode(docs, vocab, **bounds)
        assert {r.doc_id: r.token_ids for r in got.collect()} == want


def test_edges_match_library(spark):
    chars = sorted({c for t in EDGE for c in t.lower()} | set("abcdefghijklmnopqrstuvwxyz"))
    extra = ["ᄒ", "##ᅡ", "##ᆫ", "ㄱ", "##ᄀ", "##ᅮ", "##ᆨ", "σ", "##α", "##ς", "##σ", "α", "i"]
    names = ["[UNK]", "[CLS]", "[SEP]", *chars, *("##" + c for c in chars), *extra]
    tokens = {t: i for i, t in enumerate(dict.fromkeys(names))}
    small = vocabulary(spark.createDataFrame(list(tokens.items()), "token string, token_id int"))
    made = library(tokens)
    got = {r.doc_id: r.token_ids for r in wordpiece_encode(texts(spark, EDGE), small).collect()}
    assert got == {i: made.encode(t).ids for i, t in enumerate(EDGE)}


def test_caps_and_special_tokens(spark, vocab):
    df = texts(spark, ["the cat, the dog", ""])

    def run(**options):
        rows = wordpiece_encode(df, vocab, **options).collect()
        return {r.doc_id: r.token_ids for r in rows}

    whole = run()
    assert run(max_tokens=3)[0] == whole[0][:3]
    first = wordpiece_encode(texts(spark, ["the cat,"]), vocab).first().token_ids
    assert run(max_words=3)[0] == first
    special = run(special_tokens=True)
    assert special == {0: [1, *whole[0], 2], 1: [1, 2]}
    assert run(special_tokens=True, max_tokens=4)[0] == [1, *whole[0][:2], 2]


def test_special_token_missing(spark):
    small = vocabulary(spark.createDataFrame([("a", 0)], "token string, token_id int"))
    with pytest.raises(ValueError):
        wordpiece_encode(texts(spark, ["a"]), small)
