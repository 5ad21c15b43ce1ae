"""Tables kept in files of one key range each, with a manifest for every run.

A run writes its rows ordered by key into a folder of its own, then a manifest
of its files (path, least and greatest key, rows). A reader takes the newest
complete manifest and opens only files whose range it asks for; rows of a file
are in order, so nothing is shuffled. A rerun replaces the table as a whole:
until its manifest is there readers see the run before, and what no manifest
names any more is deleted afterwards.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and its entries by name."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.listStatus(place) if files.exists(place) else []
    return files, {status.getPath().getName(): status.getPath() for status in found}


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Complete manifests, the newest last."""
    files, found = _folder(spark, path)
    join = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    done = [n for n, place in found.items() if n.startswith("manifest-") and files.exists(join(place, "_SUCCESS"))]
    return sorted(done)


def write_keyed(df: DataFrame, path: str, key: str, files: int | None = None) -> None:
    """Replaces the table at ``path``. ``files`` is the number of key ranges,
    the session's number of shuffle partitions by default; equal keys are in one
    file, null first."""
    spark = df.sparkSession
    run = f"{path}/run-{uuid.uuid4().hex}"
    order = F.col(key).asc_nulls_first()
    ranged = df.repartitionByRange(files, order) if files else df.repartitionByRange(order)
    ranged.sortWithinPartitions(order).write.parquet(run)
    rows = spark.read.schema(df.schema).parquet(run)
    name = F.col("_metadata.file_path")
    manifest = rows.groupBy(name.alias("file")).agg(
        F.min(key).alias("least"),
        F.max(key).alias("greatest"),
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.lit(1)) - F.count(key)).alias("n_null"),
    )
    at = f"manifest-{time.time_ns():020d}"
    manifest.coalesce(1).write.parquet(f"{path}/{at}")
    _clean(spark, path, at, run.rsplit("/", 1)[1])


def _clean(spark: SparkSession, path: str, manifest: str, run: str) -> None:
    """Deletes runs and manifests before the newest one."""
    files, found = _folder(spark, path)
    for name, place in found.items():
        old = name.startswith("run-") and name != run or name.startswith("manifest-") and name < manifest
        if old:
            files.delete(place, True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``least``, ``greatest``, ``n_rows`` and ``n_null`` of the newest
    run."""
    known = _manifests(spark, path)
    if not known:
        raise FileNotFoundError(f"no complete run at {path}")
    return spark.read.parquet(f"{path}/{known[-1]}")


def read_keyed(
    spark: SparkSession, path: str, key: str, least: object = None, greatest: object = None
) -> DataFrame:
    """The rows with a key from ``least`` to ``greatest``; without either the
    whole table. Only files that can hold such keys are opened."""
    manifest = read_manifest(spark, path)
    schema = spark.read.parquet(manifest.first()["file"]).schema if manifest.limit(1).count() else None
    wanted = manifest
    if least is not None:
        wanted = wanted.filter(F.col("greatest") >= F.lit(least))
    if greatest is not None:
        wanted = wanted.filter(F.col("least") <= F.lit(greatest))
    files = [r["file"] for r in wanted.select("file").collect()]
    if not files:
        if schema is None:
            raise ValueError(f"the table at {path} has no rows")
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*files)
    if least is not None:
        rows = rows.filter(F.col(key) >= F.lit(least))
    if greatest is not None:
        rows = rows.filter(F.col(key) <= F.lit(greatest))
    return rows
