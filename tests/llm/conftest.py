import random

import pytest
from samples import frame, words


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(7)
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, "   \n\t ", None, None),
        (4, "one", "xx", ""),
        (None, "no id here", "en", "b"),
        (5, "x" * 30_000, "en", "b"),
        (6, words(rng, 20_000), "en", "c"),
        (7, "日本語 😀 é ß\x1c a b", "en", "c"),
        (8, "same id, one text", "en", "a"),
        (8, "same id, other text", "en", "a"),
        (9, "a repeated row", "en", "a"),
        (9, "a repeated row", "en", "a"),
        (10, "<|endoftext|> it's we'll 123", "en", None),
    ]
    return rows + [(100 + i, words(rng, rng.randint(1, 300)), "en", rng.choice("abc")) for i in range(60)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).persist()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, []).persist()
