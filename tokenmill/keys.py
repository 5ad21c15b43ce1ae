"""Joins on grouping columns that may hold NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on_groups(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which a NULL key matches a NULL key; keys come from the
    left side."""
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    on = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    )
    return left.join(renamed, on, how).drop(*[f"_key_{k}" for k in keys])
