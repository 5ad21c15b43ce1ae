"""Measurement files: CSV shapes, summaries, log lines and nested results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.scratch import stored
from tokenmill.sizes import broadcast_if_small

# The columns of each CSV shape in file order, with their name in
# the common table.
SHAPES: dict[str, dict[str, tuple[str, str]]] = {
    "comprehensive": {
        "Scenario": ("scenario", "string"),
        "PayloadKB": ("payload_kb", "int"),
        "Iteration": ("iteration", "string"),
        "TextGen_us": ("textgen_us", "double"),
        "Tokenize_us": ("tokenize_us", "double"),
        "DPU_Total_us": ("total_us", "double"),
        "RDMA_us": ("transfer_us", "double"),
        "GPU_Compute_us": ("compute_us", "double"),
        "GPU_Util_Pct": ("gpu_util_pct", "double"),
        "GPU_Mem_MB": ("gpu_mem_mb", "int"),
        "DPU_CPU_Pct": ("cpu_pct", "int"),
    },
    "timing": {
        "Scenario": ("scenario", "string"),
        "PayloadKB": ("payload_kb", "int"),
        "Run": ("run", "int"),
        "TextGen_us": ("textgen_us", "double"),
        "Tokenize_us": ("tokenize_us", "double"),
        "DPU_Total_us": ("total_us", "double"),
        "RDMA_us": ("transfer_us", "double"),
        "GPU_Compute_us": ("compute_us", "double"),
    },
    "results": {
        "Scenario": ("scenario", "string"),
        "PayloadKB": ("payload_kb", "int"),
        "Run": ("run", "int"),
        "DPU_TextGen_us": ("textgen_us", "int"),
        "DPU_Tokenize_us": ("tokenize_us", "int"),
        "RDMA_Latency_us": ("transfer_us", "double"),
        "GPU_Compute_us": ("compute_us", "double"),
        "GPU_Util_Percent": ("gpu_util_pct", "int"),
        "GPU_Mem_MB": ("gpu_mem_mb", "int"),
    },
}

# Columns of the summary table after its three header lines.
SUMMARY_SCHEMA = (
    "scenario string, payload_kb int, textgen_us_mean double, textgen_us_std double, "
    "tokenize_us_mean double, tokenize_us_std double, total_us_mean double, "
    "total_us_std double, transfer_us_mean double, transfer_us_std double, "
    "compute_us_mean double, compute_us_std double, compute_us_min double, "
    "compute_us_max double, gpu_util_pct_mean double, gpu_mem_mb_mean double, "
    "cpu_pct_mean double"
)

# Names that mark a measured value in a log line.
LOG_MARKERS = (
    "DPU_TEXTGEN_TIME",
    "DPU_TOKENIZE_TIME",
    "DPU_TOTAL_TIME",
    "LATENCY_RESULT",
    "COMPUTE_RESULT",
    "COMPUTE_LATENCY",
    "CPU_BPE_TIME",
    "CPU_WORDPIECE_TIME",
    "WORDPIECE_TIME",
    "WORDPIECE_TOKENS",
    "WORDPIECE_GPU_TIME",
    "WORDPIECE_GPU_TOKENS",
)

# Key names of the nested results.
RESULT_SCHEMA = (
    "payload_kb int, text_bytes int, iterations int, tokenizers map<string, struct<"
    "name: string, platform: string, implementation: string, mean_us: double, "
    "min_us: double, max_us: double, std_us: double, tokens: int, iterations: int, "
    "text_bytes: int>>"
)


def read_measurements(spark: SparkSession, path: str | list[str], shape: str) -> DataFrame:
    """One CSV shape under the common names, with ``run`` and ``is_warmup``.

    The header line has to name the expected columns.
    """
    columns = SHAPES[shape]
    schema = ", ".join(f"{name} {kind}" for name, (_, kind) in columns.items())
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
        .withColumnsRenamed({name: common for name, (common, _) in columns.items()})
    )
    times = [c for c in df.columns if c.endswith(("_us", "_util_pct"))]
    df = df.withColumns({c: F.col(c).cast("double") for c in times})
    if "iteration" not in df.columns:
        return df.withColumn("is_warmup", F.lit(False))
    number = F.regexp_extract("iteration", "([0-9]+)$", 1).cast("int")
    return df.withColumns(
        {"run": number, "is_warmup": F.col("iteration").startswith("warmup")}
    )


def union_measurements(parts: Sequence[DataFrame]) -> DataFrame:
    """All measurements in one table; columns a file lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_all_measurements(spark: SparkSession, paths: Mapping[str, Sequence[str]]) -> DataFrame:
    """Files by shape, read and put together."""
    return union_measurements(
        [read_measurements(spark, list(files), shape) for shape, files in paths.items()]
    )


def file_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file_path``, ``header`` and ``shape`` of every CSV file: its first line,
    and the shape whose columns that names, NULL if none does.

    One pass over the files that sends a line for each file.
    """
    lines = spark.read.text(path).select(
        "_metadata.file_path",
        "_metadata.file_block_start",
        F.rtrim(F.regexp_replace("value", "[\r\ufeff]", "")).alias("header"),
        # lines of a task are numbered in their order
        F.monotonically_increasing_id().alias("_at"),
    )
    first = lines.filter("file_block_start = 0").groupBy("file_path").agg(F.min_by("header", "_at").alias("header"))
    shape = F.lit(None).cast("string")
    for name, columns in SHAPES.items():
        shape = F.when(F.col("header") == ",".join(columns), name).otherwise(shape)
    return first.withColumn("shape", shape)


def unknown_headers(headers: DataFrame) -> DataFrame:
    """Files whose first line names the columns of no shape."""
    return headers.filter("shape IS NULL").select("file_path", "header")


#: Columns of the common table with the types that ``union_measurements`` gives.
COMMON = {
    "scenario": "string", "payload_kb": "int", "iteration": "string", "textgen_us": "double",
    "tokenize_us": "double", "total_us": "double", "transfer_us": "double", "compute_us": "double",
    "gpu_util_pct": "double", "gpu_mem_mb": "int", "cpu_pct": "int", "run": "int",
}


def read_mixed_measurements(
    spark: SparkSession, path: str | list[str], headers: DataFrame | None = None
) -> DataFrame:
    """CSV files of any of the shapes in one table, each file by its own header.

    ``headers`` are those of :func:`file_headers`. Files with other headers are
    left out; ``unknown_headers`` lists them. The lines are read once, whatever
    the number of shapes, and parsed by the shape of their file.
    """
    known = stored(file_headers(spark, path) if headers is None else headers, "csv-headers")
    known = known.filter("shape IS NOT NULL").select("file_path", "header", "shape")
    sized = broadcast_if_small(known, F.octet_length("file_path") + F.octet_length("header") + 32)
    lines = spark.read.text(path).select("_metadata.file_path", F.regexp_replace("value", "[\r\ufeff]", "").alias("line"))
    rows = lines.join(sized, "file_path").filter((F.rtrim("line") != F.col("header")) & (F.trim("line") != ""))
    parsed = {}
    for name, columns in SHAPES.items():
        schema = ", ".join(f"{common} {COMMON[common]}" for common, _ in columns.values())
        parsed[f"_{name}"] = F.when(F.col("shape") == name, F.from_csv("line", schema))
    rows = rows.withColumns(parsed)
    cells = []
    for common, kind in COMMON.items():
        found = [
            F.col(f"_{name}.{common}") for name, columns in SHAPES.items() if common in {c for c, _ in columns.values()}
        ]
        cells.append(F.coalesce(*found).cast(kind).alias(common))
    number = F.regexp_extract("iteration", "([0-9]+)$", 1).cast("int")
    return rows.select(*cells).withColumns(
        {
            "run": F.coalesce("run", number),
            "is_warmup": F.coalesce(F.col("iteration").startswith("warmup"), F.lit(False)),
        }
    )


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary table, whose two-level header takes three lines."""
    lines = F.split("value", "\r\n|\n")
    body = F.filter(lines, lambda line, at: (at >= 3) & (line != ""))
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(body).alias("_line"))
        .select(F.from_csv("_line", SUMMARY_SCHEMA).alias("_row"))
        .select("_row.*")
    )


def read_log_markers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, marker, value)`` of every log line that reports a value."""
    pattern = f"\\b({'|'.join(LOG_MARKERS)}): ([0-9]+(?:\\.[0-9]+)?)"
    return (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("path"), "value")
        .select(
            "path",
            F.regexp_extract("value", pattern, 1).alias("marker"),
            F.regexp_extract("value", pattern, 2).cast("double").alias("value"),
        )
        .filter(F.col("marker") != "")
    )


def markers_per_file(markers: DataFrame) -> DataFrame:
    """One row per file and one column per marker (mean when repeated)."""
    return markers.groupBy("path").pivot("marker", list(LOG_MARKERS)).agg(F.avg("value"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Nested benchmark results, one JSON document per file or line."""
    return spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(path)


def explode_results(results: DataFrame) -> DataFrame:
    """One row per tokenizer of every result."""
    return results.select(
        "payload_kb", F.explode("tokenizers").alias("tokenizer", "_r")
    ).select("payload_kb", "tokenizer", "_r.*")


def nest_results(rows: DataFrame) -> DataFrame:
    """The inverse of :func:`explode_results`."""
    fields = [
        "name", "platform", "implementation", "mean_us", "min_us", "max_us", "std_us",
        "tokens", "iterations", "text_bytes",
    ]
    entry = F.struct("tokenizer", F.struct(*fields))
    return rows.groupBy("payload_kb").agg(
        F.max("text_bytes").alias("text_bytes"),
        F.max("iterations").alias("iterations"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("tokenizers"),
    )
