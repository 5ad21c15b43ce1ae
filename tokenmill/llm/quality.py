"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared
with references of its language by Jensen-Shannon distance (base 2, 0 to 1).
Symbols between words, shouting, tables and word salad move one of them far
from what the language looks like. Short texts have noisy histograms: each
comparison has a length below which it abstains, and the distance allowed for
words adds to ``Limits.words`` what random texts of that many words reach that
are drawn from the reference itself.

The references are statistics of all documents. A word is common in a language
if it is at least ``COMMON`` of its words; such words are found in two passes:

1. Each batch names the words that are at least ``COMMON / 2`` of its words,
   with their counts. A common word reaches that share in some batch, and only
   words whose counts could still add up to ``COMMON`` of the language stay:
   at most 2 / COMMON for each language, whatever the size of the corpus.
2. Those are counted exactly.

A language needs ``LANGUAGE`` words for a reference of its own, however small its
share of the corpus. A document without a language is compared with the language
whose words are nearest to its own. A document of a language without reference,
or without a language where there is no reference, is not judged by its words,
and by its character classes against those of all documents, letters without
case counted as lower-case ones.

Words are maximal runs without blank and the controls 9 to 13; a null text has
none. Null ids and languages, repeated rows and empty tables are no exception:
each row gives one row.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import extended, frugal, sub_batches
from tokenmill.scratch import stored

COMMON = 0.002
LANGUAGE = 2000
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
CLASSES = ("lower", "upper", "letter", "digit", "space", "punctuation", "symbol", "other")
#: Characters counted as symbols whatever their category: marks of markup and
#: tables rather than of prose.
MARKS = SYMBOLS + "+=^_~`\\{}@"


def _class_table(size: int = 0x3000) -> np.ndarray:
    """Class of each code point below ``size``."""
    out = np.full(size, CLASSES.index("other"), dtype=np.uint8)
    kinds = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Z": "space", "L": "letter", "M": "letter"}
    kinds |= {"N": "digit", "P": "punctuation", "S": "symbol"}
    for code in range(size):
        category = unicodedata.category(chr(code))
        kind = kinds.get(category) or kinds.get(category[0])
        if chr(code) in SPACE:
            kind = "space"
        elif chr(code) in MARKS:
            kind = "symbol"
        if kind:
            out[code] = CLASSES.index(kind)
    return out


TABLE = _class_table()
BEYOND = np.append(TABLE, CLASSES.index("letter"))  # scripts above are letters


def class_counts(text: str) -> np.ndarray:
    """Characters of each class."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.bincount(BEYOND[np.minimum(codes, len(TABLE))], minlength=len(CLASSES))


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in windows of three that come twice or more; each word counts
    once."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct > 1_000_000:  # keep the product of three within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * distinct + ids[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def numbered(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    """Each word's number in order of first use, and the words."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    ids = np.fromiter((number(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    return ids, known


def base_counts(text: str, ids: np.ndarray, distinct: int) -> dict[str, int]:
    """The counts of the rules."""
    lines = Counter(text.split("\n"))
    return {
        "n_words": len(ids),
        "word_chars": len(text) - sum(map(text.count, SPACE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": sum(n - 1 for line, n in lines.items() if n > 1 and line.strip(SPACE)),
        "n_repeat_words": repeated_words(ids, distinct),
    }


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Root of the Jensen-Shannon divergence, base 2, of two histograms."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def entropy(x: np.ndarray) -> float:
        x = x[x > 0]
        return float(-(x * np.log2(x)).sum())

    return max(0.0, entropy(m) - (entropy(p) + entropy(q)) / 2) ** 0.5


#: Lengths at which chance distances are drawn.
LENGTHS = tuple(50 * 2**i for i in range(12))
DRAWS = 200


def chance_distances(words: np.ndarray, seed: int = 42) -> np.ndarray:
    """Greatest distance to a histogram among random texts drawn from it, for
    each length."""
    if not words.sum():
        return np.zeros(len(LENGTHS))
    rng, share = np.random.default_rng(seed), words / words.sum()
    return np.array([max(js_distance(d, share) for d in rng.multinomial(n, share, DRAWS)) for n in LENGTHS])


@dataclass
class Reference:
    """Histograms of a language: classes, and common words with the rest at the
    end."""

    classes: np.ndarray
    place: dict[bytes, int] = field(default_factory=dict)
    words: np.ndarray = field(default_factory=lambda: np.zeros(1))
    noise: np.ndarray = field(default_factory=lambda: np.zeros(len(LENGTHS)))
    #: Whether letters without case count as lower-case ones.
    caseless: bool = False

    def word_limit(self, n_words: int, allowed: float) -> float:
        """Distance allowed for a text of that length."""
        chance = np.interp(np.log(max(1, n_words)), np.log(LENGTHS), self.noise)
        return float((allowed**2 + chance**2) ** 0.5)


@dataclass
class Limits:
    """Largest distances, and the words below which a comparison abstains."""

    classes: float = 0.3
    words: float = 0.18
    classes_min_words: int = 50
    words_min_words: int = 50


# -- references --------------------------------------------------------------


def _languages(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """Texts by language, and all texts under the empty name."""
    by: dict[str, list[str]] = {}
    texts = [x or "" for x in batch.column("_text").to_pylist()]
    for lang, text in zip(batch.column("_lang").to_pylist(), texts):
        if lang:
            by.setdefault(lang, []).append(text)
    yield "", texts
    yield from by.items()


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "_text", 4 << 20):
        rows = []
        for lang, texts in _languages(batch):
            words: Counter = Counter()
            classes = np.zeros(len(CLASSES), dtype=np.int64)
            for text in texts:
                words.update(text.encode().split())
                classes += class_counts(text)
            total = words.total()
            rows += [(lang, None, i, int(n), total) for i, n in enumerate(classes)]
            least = COMMON / 2 * total
            rows += [(lang, w, None, n, total) for w, n in words.items() if n >= least]
        columns = list(zip(*rows))
        kinds = (pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
        names = ["lang", "word", "class", "n", "total"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def references(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, Reference]:
    """Reference of each language, and of all documents under the empty name."""
    texts = df.select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    first = texts.mapInArrow(frugal(_first_pass), "lang string, word binary, class int, n long, total long")
    first = first.groupBy("lang", "word", "class").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    first = stored(first, "quality-counts")
    totals = first.where("class = 0").select("lang", F.col("total").alias("words"))
    everything = totals.where("lang = ''").first()
    if everything is None:
        return {"": Reference(np.zeros(len(CLASSES)))}
    kept = totals.where((F.col("words") >= LANGUAGE) | (F.col("lang") == ""))
    sizes = {r["lang"]: r["words"] for r in kept.collect()}
    out = {lang: Reference(np.zeros(len(CLASSES))) for lang in sizes}
    counts = first.join(F.broadcast(kept), "lang")
    for r in counts.where("class is not null").collect():
        out[r["lang"]].classes[r["class"]] = r["n"]
    # of each language at most 2 / COMMON words pass
    possible = F.col("n") + COMMON / 2 * (F.col("words") - F.col("total")) >= COMMON * F.col("words")
    wanted: dict[str, set[bytes]] = {lang: set() for lang in sizes}
    for r in counts.where("word is not null").where(possible).select("lang", "word").collect():
        wanted[r["lang"]].add(bytes(r["word"]))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = {lang: Counter(dict.fromkeys(words, 0)) for lang, words in wanted.items()}
        for batch in sub_batches(batches, "_text", 4 << 20):
            for lang, texts in _languages(batch):
                if lang in counted:
                    mine = counted[lang]
                    for text in texts:
                        for word in filter(mine.__contains__, text.encode().split()):
                            mine[word] += 1
        rows = [(lang, w, n) for lang, words in counted.items() for w, n in words.items() if n]
        if rows:
            columns = list(zip(*rows))
            kinds = (pa.string(), pa.binary(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "word", "n"])

    second = texts.mapInArrow(frugal(second_pass), "lang string, word binary, n long")
    common: dict[str, list[tuple[bytes, int]]] = {lang: [] for lang in sizes}
    for r in second.groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        if r["n"] >= COMMON * sizes[r["lang"]]:
            common[r["lang"]].append((bytes(r["word"]), r["n"]))
    for lang, ref in out.items():
        words = sorted(common[lang])
        ref.place = {w: i for i, (w, _) in enumerate(words)}
        counts_ = [n for _, n in words]
        ref.words = np.array([*counts_, sizes[lang] - sum(counts_)], dtype=float)
        ref.noise = chance_distances(ref.words)
    return out


# -- rules -------------------------------------------------------------------

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "class_distance double, word_distance double, base_failed boolean, kept boolean"
)


def caseless(classes: np.ndarray) -> np.ndarray:
    """Classes with letters without case among the lower-case ones."""
    out, lower, letter = classes.copy(), CLASSES.index("lower"), CLASSES.index("letter")
    out[lower] += out[letter]
    out[letter] = 0
    return out


def word_distance(ids: np.ndarray, known: dict[bytes, int], ref: Reference) -> float:
    """Distance of the words of a text to a reference."""
    seen = np.zeros(len(ref.words))
    if len(ids):
        uses = np.bincount(ids)
        place = ref.place
        for word in place.keys() & known.keys():
            seen[place[word]] = uses[known[word]]
        seen[-1] = len(ids) - seen.sum()
    return js_distance(seen, ref.words)


def judge(text: str, ref: Reference | list[Reference], limits: Limits) -> tuple:
    """The values of SCHEMA for one text; of several references the one with the
    nearest words counts."""
    ids, known = numbered(text.encode().split())
    base = base_counts(text, ids, len(known))
    n = base["n_words"]
    if isinstance(ref, list):
        by_word, ref = min(((word_distance(ids, known, r), r) for r in ref), key=lambda x: x[0])
    else:
        by_word = word_distance(ids, known, ref)
    counts = class_counts(text)
    by_class = js_distance(caseless(counts) if ref.caseless else counts, ref.classes)
    failed = n < MIN_WORDS or 100 * base["n_repeat_words"] > 50 * n
    far = (n >= limits.classes_min_words and by_class > limits.classes) or (
        n >= limits.words_min_words and by_word > ref.word_limit(n, limits.words)
    )
    return (*base.values(), by_class, by_word, failed, not failed and not far)


def reference_for(lang: str | None, refs: dict[str, Reference]) -> Reference | list[Reference]:
    """What a document of that language is compared with."""
    if lang and lang in refs:
        return refs[lang]
    # a reference without words gives the distance 0
    return (not lang and [r for g, r in refs.items() if g]) or Reference(caseless(refs[""].classes), caseless=True)


def quality_rules(
    df: DataFrame,
    limits: Limits | None = None,
    text_col: str = "text",
    lang_col: str = "lang",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Columns ``keep`` and the columns of SCHEMA for each row."""
    refs = references(df, text_col, lang_col)
    limits = limits or Limits()
    text = text_col if text_col in keep else "_text"  # sent once
    rows = df.select(*keep, *([] if text in keep else [df[text_col].alias(text)]), df[lang_col].cast("string").alias("_lang"))
    names = SCHEMA.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        fields = [n.split() for n in names]
        for batch in sub_batches(batches, text, 4 << 20):
            found = []
            for lang, one in zip(batch.column("_lang").to_pylist(), batch.column(text).to_pylist()):
                found.append(judge(one or "", reference_for(lang, refs), limits))
            columns = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*found), fields)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *columns], names=[*keep, *(n for n, _ in fields)]
            )

    return rows.mapInArrow(frugal(run), extended(df, keep, SCHEMA))
