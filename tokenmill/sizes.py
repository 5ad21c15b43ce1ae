"""Size bounds behind every broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 << 20


def broadcast_if_small(
    df: DataFrame,
    row_bytes: Column,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``df`` marked for broadcast when its counted size is in bounds, else
    unmarked, so that the join shuffles and AQE splits skewed keys."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(row_bytes)).first()
    if rows <= max_rows and (size or 0) <= max_bytes:
        return F.broadcast(df)
    return df
