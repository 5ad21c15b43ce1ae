"""Speedups, rankings and timelines over one row per algorithm and platform
or per scenario and stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenmill.keys import join_on_groups


def speedup_vs_slowest(times: DataFrame, algo: str, time: str = "time_us") -> DataFrame:
    """Slowest time of the algorithm over the row's time."""
    slowest = times.groupBy(algo).agg(F.max(time).alias("_slowest"))
    return (
        join_on_groups(times, slowest, [algo])
        .withColumn("speedup", F.col("_slowest") / F.col(time))
        .drop("_slowest")
    )


def speedup_vs_baseline(
    times: DataFrame, algo: str, platform: str, baseline, time: str = "time_us"
) -> DataFrame:
    """Time of the named platform over the row's time, within the algorithm."""
    base = (
        times.filter(F.col(platform) == F.lit(baseline))
        .groupBy(algo)
        .agg(F.max(time).alias("_base"))
    )
    return (
        join_on_groups(times, base, [algo], "left")
        .withColumn("speedup", F.col("_base") / F.col(time))
        .drop("_base")
    )


def platform_rank(
    times: DataFrame, algo: str, platform: str, time: str = "time_us"
) -> DataFrame:
    """Place of every platform within its algorithm, the fastest first."""
    order = W.partitionBy(algo).orderBy(time, platform)
    return times.withColumn("place", F.row_number().over(order))


def best_platform(
    times: DataFrame, algo: str, platform: str, time: str = "time_us"
) -> DataFrame:
    """Fastest platform per algorithm and how much faster than the slowest."""
    first = F.min(F.struct(time, platform))
    return (
        times.groupBy(algo)
        .agg(first.alias("_first"), F.max(time).alias("_slowest"))
        .select(
            algo,
            F.col(f"_first.{platform}").alias("best_platform"),
            F.col(f"_first.{time}").alias("best_us"),
            (F.col("_slowest") / F.col(f"_first.{time}")).alias("factor"),
        )
    )


def fastest_first(times: DataFrame, time: str = "time_us", *ties: str) -> DataFrame:
    return times.orderBy(time, *ties)


def stage_timeline(
    stages: DataFrame, groups: Sequence[str], order: Column, time: str = "time_us"
) -> DataFrame:
    """Start and end of every stage of a scenario in stage order."""
    in_order = W.partitionBy(*groups).orderBy(order)
    before = F.sum(time).over(in_order.rowsBetween(W.unboundedPreceding, -1))
    ended = F.sum(time).over(in_order.rowsBetween(W.unboundedPreceding, 0))
    return stages.withColumns({"end_us": ended, "start_us": F.coalesce(before, F.lit(0.0))})
