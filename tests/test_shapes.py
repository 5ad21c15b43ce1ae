from pyspark.sql import functions as F

from plain import SYMBOLS, greedy, longest_matches
from tokenmill.functions import shape, synth
from tokenmill.functions.hashing import hash_tokens
from tokenmill.operators.vocabulary import vocabulary
from tokenmill.plans.batches import padded_batches, transfer_modes


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def plain_hash(data: bytes, modulus: int):
    out = []
    for at in range(0, len(data) // 4 * 4, 4):
        h = 5381
        for b in data[at : at + 4]:
            h = (h * 33 + b) & 0xFFFFFFFF
        out.append(h % modulus)
    return out


def test_hash_tokens(spark):
    values = ["", "abc", "abcd", "für 😀 und mehr", "ÿÿÿÿ" * 3, "x" * 1001]
    for modulus in (50257, 30522):
        rows = texts(spark, values).select(
            "doc_id", hash_tokens(F.col("text"), modulus).alias("ids")
        )
        assert {r.doc_id: r.ids for r in rows.collect()} == {
            i: plain_hash(t.encode(), modulus) for i, t in enumerate(values)
        }


def test_clamps(spark):
    df = spark.createDataFrame([(-3,), (0,), (8,), (500,)], "n int")
    assert [r[0] for r in df.select(shape.clamp_payload_kb(F.col("n"))).collect()] == [1, 1, 8, 128]
    assert [shape.clamp_batch_size(n) for n in (-1, 0, 5, 99)] == [1, 1, 5, 32]


def test_slices_cut_bytes(spark):
    values = ["abcdefghijk", "äöü", "ab"]
    rows = shape.batch_slices(texts(spark, values), 3).collect()
    for i, text in enumerate(values):
        data = text.encode()
        each = len(data) // 3
        got = [r for r in sorted(rows, key=lambda r: r.batch_idx) if r.doc_id == i]
        assert [r.text.encode("latin-1") for r in got] == [
            data[b * each : (b + 1) * each] for b in range(3)
        ]
        assert {r.seq_len for r in got} == {each // 4}


def test_padded_batches(spark):
    tokens = {s: i + 1 for i, s in enumerate(SYMBOLS)} | {"ab": 300, "Ġabc": 301, "abcd": 302}
    vocab = vocabulary(spark.createDataFrame(list(tokens.items()), "token string, token_id int"))
    values = ["abcd abc ab\nabcd " * 5, "ää ab " * 7, "ab", ""]
    df = texts(spark, values)
    batches = padded_batches(df, vocab, 4)
    rows = {(r.doc_id, r.batch_idx): r for r in batches.collect()}
    assert len(rows) == 16
    for i, text in enumerate(values):
        data = text.encode()
        each = len(data) // 4
        for b in range(4):
            # the byte view stands for the bytes of the slice
            out = []
            view = data[b * each : (b + 1) * each].decode("latin-1")
            from plain import spaced_words

            for word, space in spaced_words(view):
                form = "".join(SYMBOLS[ord(c)] for c in word)
                prefix = "Ġ" if space and out else ""
                if prefix + form in tokens:
                    out.append(tokens[prefix + form])
                else:
                    out += ([tokens["Ġ"]] if prefix else []) + longest_matches(form, tokens)
            length = each // 4
            assert rows[i, b].token_ids == (out[:length] + [0] * length)[:length]
    modes = {(r.doc_id, r.mode): r.n_bytes for r in transfer_modes(df, batches).collect()}
    assert modes[0, "B"] == len(values[0]) and modes[0, "A"] == 16 * (len(values[0]) // 4 // 4)


def test_pattern_text(spark):
    df = spark.createDataFrame([(0,), (1,), (10,), (129,), (131,), (1000,)], "n long")
    for row in df.select("n", synth.pattern_text(F.col("n")).alias("t")).collect():
        assert row.t == "".join(
            " " if i % 5 == 4 else chr(97 + i % 26) for i in range(row.n)
        )
    assert synth.generate_texts(spark, 1, 1, "pattern").first().text[:10] == "abcd fghi "


def test_random_texts_are_repeatable(spark):
    for kind in ("letters", "words"):
        a = synth.generate_texts(spark, 20, 2, kind, 42)
        b = synth.generate_texts(spark, 20, 2, kind, 42).repartition(5)
        other = synth.generate_texts(spark, 20, 2, kind, 43)
        assert a.exceptAll(b).count() == 0
        assert a.intersect(other).count() == 0
        for row in a.collect():
            assert len(row.text) in (2048, 2047)
            if kind == "letters":
                assert all((c == " ") == (i % 5 == 4) for i, c in enumerate(row.text))
            else:
                assert {len(w) for w in row.text.split(" ")[:-1]} <= {4, 5, 6, 7, 8}


def test_greedy_reference_is_consistent():
    tokens = {"a": 0, "ab": 1, "c": 2, "Ġ": 3, "Ġab": 4}
    assert greedy("c abc", tokens) == [2, 3, 1, 2]
