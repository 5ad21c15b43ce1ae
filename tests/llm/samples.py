"""Small documents for the tests."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that the operators use for their own results.
CLASH = ["n_words", "kept", "size", "ids", "_text", "score", "shard", "row", "label", "rejected"]


def words(rng, n, syllables=("ka", "lo", "mi", "ter", "on", "ba", "ru", "ze")):
    out = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join("the" if rng.random() < 0.2 else w for w in out)


def frame(spark, rows):
    """Documents with more columns that carry clashing names."""
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    for name in CLASH:
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df.repartition(3)
