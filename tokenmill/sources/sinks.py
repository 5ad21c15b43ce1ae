"""Writing tokenized texts and measurement tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.sources.layout import write_keyed


def write_transfer(
    path: str,
    texts: DataFrame | None = None,
    batches: DataFrame | None = None,
    mode: str = "overwrite",
    key: str | None = None,
) -> None:
    """Texts as they are (folder ``mode=B``), padded token rows
    (``mode=A``), or both.

    With a ``key`` each is a table of key ranges with a manifest
    (:mod:`tokenmill.sources.layout`), replaced as a whole."""
    for name, rows in (("A", batches), ("B", texts)):
        if rows is None:
            continue
        if key is not None:
            write_keyed(rows, f"{path}/mode={name}", key)
        else:
            rows.write.mode(mode).parquet(f"{path}/mode={name}")


def write_tokens(encoded: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    encoded.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_statistics(stats: DataFrame, path: str, digits: int = 2) -> None:
    """A summary or percentile table as CSV with a header, rounded."""
    doubles = [f.name for f in stats.schema.fields if f.dataType.typeName() == "double"]
    rounded = stats.withColumns({c: F.round(c, digits) for c in doubles})
    rounded.write.mode("overwrite").option("header", True).csv(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
