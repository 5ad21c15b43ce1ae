"""Splitting text into the units the tokenizers look up."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a word is a run without space, newline or tab; one space
# directly before it belongs to it.
SPACED_WORD = " ?[^ \\n\\t]+"

# Fixed value: the published byte-level BPE pre-tokenization pattern.
PRE_TOKEN = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

# White space, characters dropped by cleaning, CJK ideograph
# blocks and punctuation of the published WordPiece text normalisation.
WHITE_SPACE = (
    " \\t\\n\\r\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
)
DROPPED = "[\\x00\\uFFFD\\p{Cc}\\p{Cf}\\p{Co}]"
CJK = (
    "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}"
    "\\x{2A700}-\\x{2B73F}\\x{2B740}-\\x{2B81F}\\x{2B820}-\\x{2CEAF}"
    "\\x{F900}-\\x{FAFF}\\x{2F800}-\\x{2FA1F}]"
)
PUNCTUATION = "!-/:-@\\[-`{-~\\p{P}"


def spaced_words(text: str) -> Column:
    """Words, with the space directly before them where there is one."""
    return F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0))


def pre_token_list(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0))


def chunk_list(text: str) -> Column:
    # naming the common characters first spares most of them the long set
    return F.regexp_extract_all(text, F.lit(f"[!-~[^{WHITE_SPACE}]]+"), F.lit(0))


def split_words(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per word: ``word_idx``, ``word`` and ``has_space`` replace the
    text. A text without words keeps one row with a NULL word."""
    others = [c for c in df.columns if c != text]
    return (
        df.select(
            *others,
            F.posexplode_outer(spaced_words(text)).alias("word_idx", "_spaced"),
        )
        .withColumn("has_space", F.col("_spaced").startswith(" "))
        .withColumn(
            "word",
            F.when(F.col("has_space"), F.expr("substring(_spaced, 2)")).otherwise(
                F.col("_spaced")
            ),
        )
        .select(*others, "word_idx", "word", "has_space")
    )


def split_pre_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per byte-level BPE pre-token; joined again they give the text."""
    others = [c for c in df.columns if c != text]
    return df.select(
        *others,
        F.posexplode_outer(pre_token_list(text)).alias("word_idx", "word"),
    )


def split_chunks(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per run without white space."""
    others = [c for c in df.columns if c != text]
    return df.select(
        *others,
        F.posexplode_outer(chunk_list(text)).alias("word_idx", "word"),
    )


def _single_decompositions() -> tuple[str, str]:
    """Characters whose canonical decomposition, less its combining marks, is
    one other character."""
    source, target = [], []
    for point in range(0xA0, sys.maxunicode + 1):
        char = chr(point)
        if not unicodedata.decomposition(char) or unicodedata.category(char) == "Mn":
            continue
        base = [
            c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"
        ]
        if len(base) == 1 and base[0] != char:
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


_ACCENTED, _BASE = _single_decompositions()


def _utf16(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _jamo(text: Column) -> Column:
    """Hangul syllables to their conjoining letters by the Unicode formula."""

    def one(char: Column) -> Column:
        index = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("long") - 0xAC00
        tail = index % 28
        return F.when(
            char.rlike("^[\\uAC00-\\uD7A3]$"),
            F.concat(
                _utf16((F.lit(0x1100) + F.floor(index / 588)).cast("long")),
                _utf16((F.lit(0x1161) + F.floor((index % 588) / 28)).cast("long")),
                F.when(tail > 0, _utf16((F.lit(0x11A7) + tail).cast("long"))).otherwise(""),
            ),
        ).otherwise(char)

    spelled = F.array_join(F.transform(F.split(text, ""), one), "")
    return F.when(text.rlike("[\\uAC00-\\uD7A3]"), spelled).otherwise(text)


def strip_accents(text: Column) -> Column:
    """Canonical decomposition without combining marks; plain ASCII is passed
    through untouched."""
    plain = F.regexp_replace(F.translate(_jamo(text), _ACCENTED, _BASE), "\\p{Mn}+", "")
    return F.when(text.rlike("[^\\x00-\\x7F]"), plain).otherwise(text)


def normalize(text: Column) -> Column:
    """Clean, strip accents and lower-case one chunk of text."""
    # a capital sigma is lower-cased by itself, whatever follows it
    cleaned = F.regexp_replace(text, DROPPED, "")
    return F.lower(F.translate(strip_accents(cleaned), "Σ", "σ"))


BASIC_TOKEN = (
    f"{CJK}|[{PUNCTUATION}]|"
    f"[^{WHITE_SPACE}{PUNCTUATION}&&[^{CJK[1:-1]}]]+"
)


def basic_tokens(text: Column) -> Column:
    """Words, single punctuation marks and single ideographs of a chunk."""
    return F.regexp_extract_all(normalize(text), F.lit(BASIC_TOKEN), F.lit(0))


def text_basic_tokens(text: str) -> Column:
    """The basic tokens of all chunks of a text. Cleaning drops some white space
    with the controls, so all of it is blank before."""
    return basic_tokens(F.regexp_replace(text, f"[{WHITE_SPACE}]", " "))
