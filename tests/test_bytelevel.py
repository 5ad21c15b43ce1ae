from pyspark.sql import functions as F

from plain import SYMBOLS, to_symbols
from tokenmill.functions.bytelevel import (
    byte_symbols,
    byte_view,
    from_byte_symbols,
    to_byte_symbols,
)


def test_alphabet_rule():
    symbols = byte_symbols()
    assert len(set(symbols)) == 256
    assert symbols[ord("a")] == "a" and symbols[0xE9] == "é"
    assert symbols[32] == "Ġ" and symbols[10] == "Ċ" and symbols[0] == "Ā"
    assert symbols[173] == chr(0x100 + 67)


def test_round_trip(spark):
    texts = ["", "für 😀", "".join(chr(c) for c in range(1, 256)), " \n\t\r", "中文 한국"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    symbols = to_byte_symbols(F.col("text"))
    rows = df.select(
        "text",
        symbols.alias("s"),
        from_byte_symbols(symbols).alias("back"),
        F.length(byte_view(F.col("text"))).alias("n"),
    ).collect()
    for row in rows:
        assert row.s == to_symbols(row.text.encode())
        assert row.back == row.text
        assert row.n == len(row.text.encode())
        assert set(row.s) <= set(SYMBOLS)
