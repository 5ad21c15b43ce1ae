import math

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenmill.operators import measures, ranking

# Published runs at 8 KB and the statistics published for them.
SWEEP = [
    ("warmup1", 217.19, 30.56, 30.97, 37.43), ("warmup2", 217.68, 30.44, 31.22, 49.84),
    ("warmup3", 218.01, 30.57, 94.66, 37.48), ("1", 220.75, 30.72, 31.46, 37.46),
    ("2", 209.51, 30.74, 105.49, 39.04), ("3", 212.61, 30.53, 29.93, 38.50),
    ("4", 212.77, 30.57, 32.17, 38.03), ("5", 210.00, 30.50, 29.66, 39.93),
    ("6", 210.25, 30.92, 31.37, 49.20), ("7", 210.43, 30.57, 30.31, 39.12),
    ("8", 210.03, 30.66, 31.09, 38.64), ("9", 209.40, 30.59, 31.20, 50.23),
    ("10", 214.49, 30.68, 32.25, 38.67),
]
SWEEP_STATS = {
    "textgen_us": (212.02, 3.5), "tokenize_us": (30.65, 0.12),
    "transfer_us": (38.49, 23.56), "compute_us": (40.88, 4.71, 37.46, 50.23),
}
TIMING = [
    (526.27, 29.65, 46.36), (513.29, 33.38, 45.66), (506.04, 39.01, 46.11), (538.45, 32.71, 46.49),
    (531.92, 34.38, 50.08), (514.90, 35.20, 46.19), (518.62, 34.93, 54.68), (521.35, 34.87, 46.99),
    (541.18, 35.47, 45.54), (513.89, 32.66, 46.82),
]
TIMING_STATS = {
    "Transfer": (34.23, 2.30, 34.62, 35.82, 38.69),
    "GPU": (47.49, 2.69, 46.42, 50.54, 54.27),
    "Tokenize": (522.59, 11.00, 519.99, 538.72, 540.93),
}


def test_summary_reproduces_published_row(spark):
    df = spark.createDataFrame(
        [("A", 8, *r) for r in SWEEP],
        "scenario string, payload_kb int, iteration string, textgen_us double, "
        "tokenize_us double, transfer_us double, compute_us double",
    )
    kept = measures.drop_warmup_rows(df)
    assert kept.count() == 10
    row = measures.latency_summary(kept, ["scenario", "payload_kb"], list(SWEEP_STATS)).first()
    for name, stats in SWEEP_STATS.items():
        got = [row[f"{name}_{s}"] for s in ("mean", "std", "min", "max")]
        assert [round(g, 2) for g in got][: len(stats)] == pytest.approx(stats, abs=0.0051)


def test_percentiles_reproduce_published_rows(spark):
    df = spark.createDataFrame(
        [("A", 8, *r) for r in TIMING],
        "scenario string, payload_kb int, tokenize_us double, transfer_us double, compute_us double",
    )
    long = measures.unpivot_metrics(
        df,
        ["scenario", "payload_kb"],
        {"tokenize_us": "Tokenize", "transfer_us": "Transfer", "compute_us": "GPU"},
    )
    rows = measures.latency_percentiles(long, ["scenario", "payload_kb", "metric"], "value")
    for row in rows.collect():
        got = (row.mean_us, row.std_us, row.p50, row.p90, row.p99)
        assert got == pytest.approx(TIMING_STATS[row.metric], abs=0.0101)


@pytest.mark.parametrize("limit,buckets", [(1_000_000, 4096), (50, 16), (1, 4), (7, 3)])
def test_percentiles_by_refinement(spark, limit, buckets):
    rng = random.Random(limit)
    data = [("hot", round(rng.lognormvariate(3, 2), 2)) for _ in range(4000)]
    data += [("hot", 5.0)] * 2000 + [("one", 3.5), (None, 1.0), (None, 4.0), ("gap", None)]
    data += [("wide", x) for x in (-1e12, 0.0, 1e-9, 1.0, 1e12)]
    df = spark.createDataFrame(data, "g string, v double")
    rows = measures.exact_percentiles(
        df, ["g"], "v", (0.0, 0.5, 0.9, 0.99, 1.0), limit=limit, buckets=buckets
    ).collect()
    assert {r.g for r in rows} == {"hot", "one", None, "wide"}
    for row in rows:
        values = [v for g, v in data if g == row.g and v is not None]
        want = np.percentile(values, [0, 50, 90, 99, 100])
        assert [row.p0, row.p50, row.p90, row.p99, row.p100] == pytest.approx(list(want))


def test_what_percentiles_store_does_not_grow_with_rows(spark, monkeypatch):
    """Ranges are stored, never values; the last step orders at most ``limit``
    values for each wanted rank."""
    held = []
    inner = measures.stored

    def watched(df, name):
        out = inner(df, name)
        held.append(out.count())
        return out

    monkeypatch.setattr(measures, "stored", watched)
    sizes = {}
    for n in (3000, 60_000):
        held.clear()
        df = spark.range(n).select((F.col("id") % 2).alias("g"), F.rand(n).alias("v"))
        rows = measures.exact_percentiles(df.persist(), ["g"], "v", limit=200, buckets=64)
        got = {r.g: [r.p50, r.p90, r.p99] for r in rows.collect()}
        for g, mine in got.items():
            values = [r.v for r in df.where(F.col("g") == g).collect()]
            assert mine == pytest.approx(list(np.percentile(values, [50, 90, 99])))
        sizes[n] = max(held)
    assert sizes[60_000] <= 2 * 3 * 2 + 2 and sizes[3000] <= 2 * 3 * 2 + 2


def test_skip_warmup(spark):
    data = [(i, "a" if i % 3 else None) for i in range(30)]
    df = spark.createDataFrame(data, "id long, g string")
    got = sorted(r.id for r in measures.skip_warmup(df, ["g"], "id", 2).collect())
    assert got == sorted(
        [i for i in range(30) if i % 3][2:] + [i for i in range(30) if i % 3 == 0][2:]
    )


def test_warmup_ranking_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    place = F.row_number().over(ranking.W.partitionBy("g").orderBy("id"))
    plan = df.withColumn("p", place).filter("p <= 3")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_iteration_stats(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0)], "g string, v double")
    row = measures.iteration_stats(df, ["g"], "v").first()
    assert (row.iterations, row.mean_us, row.min_us, row.max_us, row.std_us) == (2, 2, 1, 3, 1)


def test_saving_and_stage_sum(spark):
    df = spark.createDataFrame(
        [(8, "A", 40.0), (8, "B", 50.0), (8, "B", 30.0 + 40.0)], "kb int, s string, t double"
    )
    row = measures.ab_saving(df, ["kb"], "s", F.avg("t"), "A", "B").first()
    assert (row.a_us, row.b_us) == (40.0, 60.0) and row.saving_pct == pytest.approx(100 / 3)
    wide = spark.createDataFrame([(211.91, 526.27), (27.0, None)], "gen double, tok double")
    totals = [r.total for r in measures.stage_sum(wide, ["gen", "tok"], "total").collect()]
    assert totals == pytest.approx([738.18, 27.0])


# Published times per algorithm and platform, and stage times.
PLATFORMS = [
    ("bpe", "Host CPU", 332), ("bpe", "DPU ARM", 531), ("bpe", "GPU", 9235),
    ("wordpiece", "GPU", 1031), ("wordpiece", "Host CPU", 4688), ("wordpiece", "DPU ARM", 7700),
]
STAGES = [("transfer", 1011), ("embed", 46)]


@pytest.fixture(scope="module")
def times(spark):
    return spark.createDataFrame(PLATFORMS, "algo string, platform string, time_us long")


def test_speedups_and_ranks(times):
    slow = {(r.algo, r.platform): r.speedup for r in ranking.speedup_vs_slowest(times, "algo").collect()}
    assert round(slow["bpe", "Host CPU"], 1) == 27.8 and slow["wordpiece", "DPU ARM"] == 1
    base = ranking.speedup_vs_baseline(times, "algo", "platform", "GPU").collect()
    by = {(r.algo, r.platform): r.speedup for r in base}
    assert round(by["bpe", "DPU ARM"], 1) == 17.4 and by["wordpiece", "GPU"] == 1
    ranks = {(r.algo, r.platform): r.place for r in ranking.platform_rank(times, "algo", "platform").collect()}
    assert ranks["bpe", "GPU"] == 3 and ranks["wordpiece", "GPU"] == 1
    best = {r.algo: (r.best_platform, r.best_us, r.factor) for r in ranking.best_platform(times, "algo", "platform").collect()}
    assert best["bpe"][:2] == ("Host CPU", 332) and best["wordpiece"][:2] == ("GPU", 1031)
    assert [r.time_us for r in ranking.fastest_first(times).collect()] == sorted(t for *_, t in PLATFORMS)


def test_totals_shares_and_timeline(spark, times):
    bpe = times.filter("algo = 'bpe'")
    tokenize = bpe.select("platform", F.lit("tokenize").alias("stage"), F.lit(0).alias("at"), "time_us")
    rest = spark.createDataFrame(
        [(i + 1, s, t) for i, (s, t) in enumerate(STAGES)], "at int, stage string, time_us long"
    )
    # every platform runs the same later stages
    later = bpe.select("platform", F.explode(F.array(F.lit(1), F.lit(2))).alias("at")).join(rest, "at")
    stages = tokenize.unionByName(later)
    totals = {r.platform: r.total_us for r in measures.end_to_end_total(stages, ["platform"]).collect()}
    assert totals == {"Host CPU": 1389, "DPU ARM": 1588, "GPU": 10292}
    share = {(r.platform, r.stage): r.share for r in measures.stage_share(stages, ["platform"]).collect()}
    assert share["GPU", "tokenize"] == pytest.approx(9235 / 10292)
    line = ranking.stage_timeline(stages, ["platform"], F.col("at")).collect()
    spans = {(r.platform, r.stage): (r.start_us, r.end_us) for r in line}
    assert spans["DPU ARM", "transfer"] == (531, 1542) and spans["DPU ARM", "embed"] == (1542, 1588)


def test_throughput(spark):
    df = spark.createDataFrame([("c", 8192, 5481, 332)], "g string, b long, t long, us long")
    row = measures.throughput(df, ["g"], "b", "t", "us").first()
    assert round(row.mb_per_s, 1) == 23.5 and round(row.tokens_per_s) == 16509036


@pytest.mark.parametrize("odd", [[], [float("inf")], [float("-inf")], [float("nan")], [float("inf"), float("-inf"), float("nan")] * 3])
def test_percentiles_with_infinities_and_nan(spark, odd):
    """A small limit forces refinement; NaN is greater than all numbers."""
    values = [float(i) for i in range(40)] + [1.7e308, -1.7e308] + odd
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    probs = (0.0, 0.25, 0.5, 0.75, 1.0)
    row = measures.exact_percentiles(df, ["g"], "v", probs, limit=10, buckets=4).first()
    ordered = sorted(values, key=lambda v: (math.isnan(v), v))
    for p in probs:
        at = p * (len(ordered) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        want = low + (high - low) * (at - math.floor(at))
        assert row[f"p{p * 100:g}"] == pytest.approx(want, nan_ok=True)
