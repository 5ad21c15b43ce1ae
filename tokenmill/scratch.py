"""Intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_scopes: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end; nothing may read them
    later."""
    _scopes.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in _scopes.pop():
            place = hadoop(path)
            files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            files.delete(place, True)


def scratch_dir(spark: SparkSession) -> str:
    """Folder from ``spark.checkpoint.dir``; only a local session may go
    without and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tokenmill-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_dir(spark)}/{app}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write once, read from the files afterwards: cuts lineage and survives
    the loss of executors. With ``outer`` the table outlives the innermost
    ``temporary_tables`` and is deleted with the one around it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    scopes = _scopes[:-1] if outer else _scopes
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
