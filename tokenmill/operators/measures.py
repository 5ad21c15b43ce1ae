"""Statistics over measurement tables (times in microseconds)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenmill.keys import join_on_groups
from tokenmill.scratch import stored
from tokenmill.sizes import broadcast_if_small

PERCENTILES = (0.5, 0.9, 0.99)


def drop_warmup_rows(df: DataFrame, iteration: str = "iteration") -> DataFrame:
    """Rows whose iteration is labelled as warm-up are left out."""
    return df.filter(~F.coalesce(F.col(iteration), F.lit("")).startswith("warmup"))


def skip_warmup(df: DataFrame, groups: Sequence[str], order: str, n: int) -> DataFrame:
    """All rows but the first ``n`` of every group by the unique ``order``.

    Only the first rows of each group travel, at most ``n`` per map task.
    """
    place = F.row_number().over(W.partitionBy(*groups).orderBy(order))
    first = (
        df.select(*groups, order)
        .withColumn("_place", place)
        .filter(F.col("_place") <= n)
        .groupBy(*groups)
        .agg(F.max(order).alias("_last_warmup"))
    )
    # one row per group, read for its size and for the join
    sized = broadcast_if_small(stored(first, "warmup"), F.lit(32))
    kept = join_on_groups(df, sized, groups).filter(F.col(order) > F.col("_last_warmup"))
    return kept.drop("_last_warmup")


def latency_summary(df: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum per group and column."""
    stats = []
    for v in values:
        stats += [
            F.avg(v).alias(f"{v}_mean"),
            F.stddev_samp(v).alias(f"{v}_std"),
            F.min(v).alias(f"{v}_min"),
            F.max(v).alias(f"{v}_max"),
        ]
    return df.groupBy(*groups).agg(*stats)


def iteration_stats(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Mean, minimum, maximum and population deviation of the iterations."""
    return df.groupBy(*groups).agg(
        F.count(value).alias("iterations"),
        F.avg(value).alias("mean_us"),
        F.min(value).alias("min_us"),
        F.max(value).alias("max_us"),
        F.stddev_pop(value).alias("std_us"),
    )


def _ranks(total: Column, prob: float) -> tuple[Column, Column, Column]:
    place = (total - 1) * F.lit(prob)
    low = F.floor(place)
    return low, F.ceil(place), place - low


def _holds(probs: Sequence[float]) -> Column:
    """Whether the ``_count`` values after the first ``_before`` have a wanted
    rank among them."""
    wanted = [r for p in probs for r in _ranks(F.col("_total"), p)[:2]]
    end = F.col("_before") + F.col("_count")
    return F.exists(F.array(*wanted), lambda r: (r >= F.col("_before")) & (r < end))


def _inside(rows: DataFrame, ranges: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The values that lie in a range of their group, with the range; ranges of
    a group share no value."""
    sized = broadcast_if_small(ranges, F.lit(96))
    return join_on_groups(rows, sized, groups).filter(F.col("_value").between(F.col("_low"), F.col("_high")))


def exact_percentiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Sequence[float] = PERCENTILES,
    limit: int = 65_536,
    buckets: int = 4096,
) -> DataFrame:
    """Exact percentiles with linear interpolation: ``groups`` and one column
    ``p<percent>`` per probability.

    A range of values that holds a wanted rank is cut into ``buckets`` by width
    while more than ``limit`` different rows are in it: each task counts its own
    rows by bucket, so buckets are sent and not values, and only the buckets
    with a wanted rank are cut again. The values of what is left are counted and
    ordered, at most ``limit`` for each wanted rank. The input is read once for
    each round; what is shuffled does not grow with its rows. Infinities and NaN,
    which is greater than all numbers, are buckets of their own, so every round
    with two numbers splits its range.
    """
    groups = list(groups)
    value_ = F.col("_value")
    rows = df.select(*groups, F.col(value).cast("double").alias("_value")).filter(value_.isNotNull())
    bounds = [F.count(F.lit(1)).alias("_count"), F.min("_value").alias("_low"), F.max("_value").alias("_high")]
    finite = F.when(~F.isnan(value_) & (F.abs(value_) != float("inf")), value_)
    edges = [F.min(finite).alias("_least"), F.max(finite).alias("_most")]
    ranges = stored(
        rows.groupBy(*groups)
        .agg(*bounds, *edges)
        .withColumns({"_total": F.col("_count"), "_before": F.lit(0).cast("long")}),
        "value-ranges",
    )
    names = ranges.columns
    wide = (F.col("_count") > limit) & (F.col("_low") < F.col("_high"))
    while ranges.filter(wide).limit(1).count():
        # halves, so that the width of any two numbers is a number
        low, high = F.col("_least") / 2, F.col("_most") / 2
        share = F.when(high > low, (value_ / 2 - low) / (high - low)).otherwise(F.lit(0.0))
        bucket = (
            F.when(F.isnan(value_), buckets + 1)
            .when(value_ == float("inf"), buckets)
            .when(value_ == float("-inf"), -1)
            .otherwise(F.least(F.floor(share * buckets), F.lit(buckets - 1)))
        )
        kept = ["_total", "_before"]
        cut = (
            _inside(rows, ranges.filter(wide).drop("_count"), groups)
            .withColumn("_bucket", bucket.cast("long"))
            .groupBy(*groups, *kept, "_bucket")
            .agg(*bounds, *edges)
        )
        order = W.partitionBy(*groups, *kept).orderBy("_bucket")
        running = F.sum("_count").over(order.rowsBetween(W.unboundedPreceding, 0))
        cut = cut.withColumn("_before", F.col("_before") + running - F.col("_count"))
        ranges = stored(
            ranges.filter(~wide).unionByName(cut.filter(_holds(probs)).select(*names)), "value-ranges"
        )

    # a range of one value needs no rows
    single = F.col("_low") == F.col("_high")
    known = [*groups, "_total", "_before"]
    counted = (
        _inside(rows, ranges.filter(~single).select(*known, "_low", "_high"), groups)
        .groupBy(*known, "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
        .unionByName(ranges.filter(single).select(*known, F.col("_low").alias("_value"), F.col("_count").alias("_n")))
    )
    ordered = W.partitionBy(*known).orderBy("_value").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.col("_before") + F.sum("_n").over(ordered))

    def at(rank: Column) -> Column:
        inside = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
        return F.min(F.when(inside, F.col("_value")))

    stats = []
    for p in probs:
        low, high, part = _ranks(F.col("_total"), p)
        name = f"p{p * 100:g}"
        stats.append(
            (at(low) + (at(high) - at(low)) * F.max(part)).alias(name)
        )
    return ranked.groupBy(*groups).agg(*stats)


def latency_percentiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Sequence[float] = PERCENTILES,
    **bounds: int,
) -> DataFrame:
    """Mean, population deviation and exact percentiles per group."""
    plain = df.groupBy(*groups).agg(
        F.avg(value).alias("mean_us"), F.stddev_pop(value).alias("std_us")
    )
    return join_on_groups(plain, exact_percentiles(df, groups, value, probs, **bounds), groups)


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Mapping[str, str]) -> DataFrame:
    """Long form: ``metric`` names and ``value``; ``metrics`` maps columns to
    metric names."""
    named = df.select(*ids, *[F.col(c).alias(m) for c, m in metrics.items()])
    return named.unpivot(list(ids), list(metrics.values()), "metric", "value")


def ab_saving(
    df: DataFrame, keys: Sequence[str], scenario: str, value: Column, a: str, b: str
) -> DataFrame:
    """Means of two scenarios side by side and the saving of ``a`` over ``b``."""
    wide = df.groupBy(*keys).pivot(scenario, [a, b]).agg(value)
    return wide.select(
        *keys,
        F.col(a).alias("a_us"),
        F.col(b).alias("b_us"),
        ((F.col(b) - F.col(a)) / F.col(b) * 100).alias("saving_pct"),
    )


def stage_sum(df: DataFrame, stages: Sequence[str], total: str) -> DataFrame:
    """Sum of stage columns in every row; a missing stage counts as 0."""
    parts = [F.coalesce(F.col(s), F.lit(0)) for s in stages]
    return df.withColumn(total, sum(parts[1:], parts[0]))


def end_to_end_total(stages: DataFrame, groups: Sequence[str], time: str = "time_us") -> DataFrame:
    """Total time per scenario over all its stages."""
    return stages.groupBy(*groups).agg(F.sum(time).alias("total_us"))


def stage_share(stages: DataFrame, groups: Sequence[str], time: str = "time_us") -> DataFrame:
    """Share of every stage in the total of its scenario."""
    totals = end_to_end_total(stages, groups, time)
    return join_on_groups(stages, totals, groups).withColumn(
        "share", F.col(time) / F.col("total_us")
    )


def throughput(
    df: DataFrame, groups: Sequence[str], n_bytes: str, n_tokens: str, time_us: str
) -> DataFrame:
    """MiB and tokens per second from summed bytes, tokens and times."""
    seconds = F.col("total_us") / 1e6
    return (
        df.groupBy(*groups)
        .agg(
            F.sum(n_bytes).alias("n_bytes"),
            F.sum(n_tokens).alias("n_tokens"),
            F.sum(time_us).alias("total_us"),
        )
        .withColumn("mb_per_s", F.col("n_bytes") / 1024 / 1024 / seconds)
        .withColumn("tokens_per_s", F.col("n_tokens") / seconds)
    )
