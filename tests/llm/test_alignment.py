import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from samples import frame, words
from tokenizers import Tokenizer

from tokenmill.llm import alignment
from tokenmill.llm.encoders import byte_level_encoder

FIRST, SECOND = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Both libraries as they are, and every pair of tokens compared."""
    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in keep]
    byte = {chr(x): x for x in keep} | {chr(256 + i): x for i, x in enumerate(others)}

    def pieces(text):
        if not text:
            return [], []
        left = a.encode(" " + text, add_special_tokens=False).ids
        left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in left]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if any(b"".join(t for _, t in side) != whole for side in (left, right)):
            return [], []
        return left, right

    def spans(side):
        out, at = [], 0
        for i, t in side:
            out.append((i, at, at + len(t)))
            at += len(t)
        return out

    def whole(texts):
        made, held = [], Counter()
        for text in texts:
            left, right = map(spans, pieces(text))
            cuts = sorted({e for *_, e in left} & {e for *_, e in right})
            groups, start = [], 0
            for stop in cuts:
                sides = ([str(i) for i, s, e in side if s >= start and e <= stop] for side in (left, right))
                groups.append("|".join(map(",".join, sides)))
                start = stop
            links = [(i, j) for i, s, e in left for j, t, f in right if s < f and t < e]
            held.update(set(links))
            made.append((len(left), len(right), groups, links))
        best = defaultdict(int)
        for (i, _), n in held.items():
            best[i] = max(best[i], n)
        return [
            (
                n_a, n_b, len(groups), len(links),
                sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links),
                hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
            )
            for n_a, n_b, groups, links in made
        ]

    return whole


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def got(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, *(r[c] for c in COLUMNS)) for r in df.collect())


def expected(rows, plain):
    return sorted((r[0] is not None, r[0] or 0, *x) for r, x in zip(rows, plain([r[1] for r in rows])))


def test_cuts_are_all_common_ends():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 10, 100, 1000, 5000):
        for share in (0.02, 0.3, 0.9):
            every = np.arange(1, n + 1)
            a, b = (every[np.r_[rng.random(n - 1) < share, True]] for _ in range(2))
            left, right = alignment.shared_cuts(a, b)
            common = np.intersect1d(a, b)
            assert a[left].tolist() == b[right].tolist() == common.tolist()
    assert [len(x) for x in alignment.shared_cuts(np.zeros(0, int), np.zeros(0, int))] == [0, 0]


def test_no_cut_inside():
    a, b = np.r_[np.arange(1, 9999, 2), 10_000], np.r_[np.arange(2, 9999, 2), 10_000]
    assert [x.tolist() for x in alignment.shared_cuts(a, b)] == [[len(a) - 1], [len(b) - 1]]


@pytest.mark.parametrize("hot", [alignment.HOT, 40, 0])
def test_odd_rows(odd, odd_rows, plain, hot):
    small = [r for r in odd_rows if len(r[1] or "") < 5000]
    df = odd.where("text IS NULL OR char_length(text) < 5000")
    assert got(alignment.cross_aligned(df, FIRST, SECOND, hot=hot)) == expected(small, plain)


def test_strange_texts(spark, plain):
    rng = random.Random(8)
    texts = ["<s> </s> <unk> <0x41> <|endoftext|>", "▁a ▁", " lead", "trail \n", "\x00a\x01", "Œuvre ﬁne １２３ é ‍ 👩‍👩", "a" * 3000, "日本語" * 50, "\t\t  \r\n", "\x1c\x85\xa0"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 300), rng.randrange(0x2000, 0x3100), 0x1F600])) for _ in range(200)) for _ in range(30)]
    texts += [words(rng, 100) for _ in range(20)] * 2
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    assert got(alignment.cross_aligned(frame(spark, rows), FIRST, SECOND, hot=50)) == expected(rows, plain)


def test_long_text_has_whole_groups(odd):
    rows = alignment.cross_aligned(odd.where("char_length(text) >= 5000"), FIRST, SECOND).collect()
    assert len(rows) == 2
    for r in rows:
        assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]


def test_empty_table(none):
    assert alignment.cross_aligned(none, FIRST, SECOND).collect() == []


@pytest.mark.parametrize("special", [True, False])
def test_ids_like_the_library(special):
    with open(FIRST, encoding="utf-8") as file:
        data = file.read()
    mine = byte_level_encoder(data, special)
    theirs = Tokenizer.from_file(FIRST)
    theirs.encode_special_tokens = not special
    rng = random.Random(9)
    texts = ["", "a<|endoftext|> <|endoftext|>b", "<|endoftext", "it's we'll  \n\n x　  y\x85"]
    texts += [f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)} \t{chr(c)}x" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts += [words(rng, 300), "x" * 20_000]
    for text, wanted in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert mine.encode(text).tolist() == wanted.ids, text[:60]


def test_other_files_go_through_the_library():
    with open(public.path("word_bpe_49k.json"), encoding="utf-8") as file:
        data = file.read()
    theirs = Tokenizer.from_str(data)
    text = "It's A Test <|endoftext|> né"
    assert byte_level_encoder(data, True).encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids
