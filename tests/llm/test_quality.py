import random
import re
from collections import Counter

import numpy as np
import pytest

from tokenmill.llm import quality
from samples import frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    """The counts of the rules, spelled out."""
    found = WORD.findall(text or "")
    lines = (text or "").split("\n")
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    dup = sum(1 for i, line in enumerate(lines) if WORD.search(line) and line in lines[:i])
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def counts_of(r):
    return (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])


def test_counts_of_odd_rows(odd, odd_rows):
    rows = quality.quality_rules(odd, keep=("doc_id",)).collect()
    assert sorted(map(str, map(counts_of, rows))) == sorted(str(plain_counts(t)) for _, t, *_ in odd_rows)
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a\n\na\n b\na", "x y z\nx y z\n \n ", "a b", "日 本 語 日 本 語 #"])
def test_counts(text):
    ids, known = quality.numbered(text.encode().split())
    assert tuple(quality.base_counts(text, ids, len(known)).values()) == plain_counts(text)


def test_very_many_distinct_words():
    ids = np.concatenate([np.arange(10), np.arange(10)]).astype(np.int64)
    assert quality.repeated_words(ids, 2_000_000) == quality.repeated_words(ids, 10) == 20


def test_distance():
    assert quality.js_distance(np.array([1.0, 0]), np.array([0, 5.0])) == pytest.approx(1)
    assert quality.js_distance(np.array([2.0, 4]), np.array([1, 2.0])) == pytest.approx(0)
    p, q = np.array([0.2, 0.8]), np.array([0.6, 0.4])
    m = (p + q) / 2
    want = (sum(p * np.log2(p / m)) + sum(q * np.log2(q / m))) / 2
    assert quality.js_distance(p, q) == pytest.approx(want**0.5)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, 150) + ".", "en", "a") for i in range(300)]
    rows += [(300 + i, words(rng, 150, ("el", "que", "cion", "mente")), "es", "a") for i in range(200)]
    marks = [(500 + i, " ".join(w + "%%%" for w in words(rng, 150).split()), "en", "a") for i in range(10)]
    loud = [(510 + i, words(rng, 150).upper().replace(" ", "!! "), "en", "a") for i in range(10)]
    return frame(spark, rows + marks + loud).persist()


def test_references_are_exact(corpus):
    refs = quality.references(corpus)
    assert set(refs) == {"", "en", "es"}
    rows = corpus.collect()
    for lang, ref in refs.items():
        texts = [r["text"] for r in rows if lang in ("", r["lang"])]
        counts = Counter(w for t in texts for w in t.encode().split())
        total = counts.total()
        common = {w: n for w, n in counts.items() if n >= quality.COMMON * total}
        assert {w: ref.words[i] for w, i in ref.place.items()} == common
        assert ref.words.sum() == total
        assert ref.classes.tolist() == sum(quality.class_counts(t) for t in texts).tolist()


def test_junk_goes_and_clean_stays(corpus):
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(corpus).collect()}
    assert all(kept[i] for i in range(500))
    assert not any(kept[i] for i in range(500, 520))


def test_language_without_reference_uses_all(spark, corpus):
    refs = quality.references(corpus)
    text = words(random.Random(9), 100)
    assert quality.judge(text, refs.get("xx") or refs[""], quality.Limits())[-1] is True


def test_clean_texts_of_rare_or_no_language_stay(spark):
    rng = random.Random(21)
    spanish, rare = ("el", "que", "cion", "mente"), ("fjo", "nyk", "wau")
    rows = [(i, words(rng, 150), "en", "a") for i in range(300)]
    rows += [(300 + i, words(rng, 150, spanish), "es", "a") for i in range(20)]
    rows += [(500 + i, words(rng, 150, spanish), [None, ""][i % 2], "a") for i in range(10)]
    rows += [(600 + i, words(rng, 100, rare).replace("the", "hwa"), "xx", "a") for i in range(4)]
    rows += [(700 + i, " ".join(w + "%%%" for w in words(rng, 150).split()), [None, "xx"][i % 2], "a") for i in range(4)]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(frame(spark, rows)).collect()}
    assert {i for i, k in kept.items() if not k} == {700, 701, 702, 703}


def test_share_of_a_language_does_not_matter(spark):
    rng = random.Random(22)
    rows = [(i, words(rng, 20_000), "en", "a") for i in range(130)]
    rows += [(300 + i, words(rng, 150, ("el", "que")).replace("the", "del"), "es", "a") for i in range(16)]
    df = frame(spark, rows)
    assert set(quality.references(df)) == {"", "en", "es"}
    assert all(r["kept"] for r in quality.quality_rules(df).collect() if r["doc_id"] >= 300)


def test_empty_table(none):
    assert quality.quality_rules(none).collect() == []


def test_query_against_plain_version(spark):
    from tokenmill.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_divergence_rules"](spark, folder).collect()}
    assert len(rows) == len(docs)
    langs = {r["lang"] for r in docs} | {""}
    words_ = {g: Counter(w for r in docs if g in ("", r["lang"]) for w in WORD.findall(r["text"])) for g in langs}
    for d in docs:
        r = rows[d["doc_id"]]
        assert counts_of(r) == plain_counts(d["text"])
        ref = words_[d["lang"]]
        total = ref.total()
        common = sorted(w for w, n in ref.items() if n >= quality.COMMON * total)
        mine = Counter(WORD.findall(d["text"]))
        p = np.array([*(mine[w] for w in common), sum(n for w, n in mine.items() if w not in set(common))], float)
        q = np.array([*(ref[w] for w in common), total - sum(ref[w] for w in common)], float)
        assert r["word_distance"] == pytest.approx(quality.js_distance(p, q))
        limits = quality.Limits()
        far = (r["n_words"] >= limits.classes_min_words and r["class_distance"] > limits.classes) or (
            r["n_words"] >= limits.words_min_words
            and r["word_distance"] > quality.Reference(None, {}, q, quality.chance_distances(q)).word_limit(r["n_words"], limits.words)
        )
        assert r["kept"] == (not r["base_failed"] and not far)
