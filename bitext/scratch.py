"""Tables written once to the shared folder: lineage ends there, a lost executor's
part is read again, and every later branch of a plan reads the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import ensure_checkpoint_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # Spark's setting: remove shuffle files with their job


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, path: str) -> None:
    """Write ``df``.  Its shuffle files go with the job, as what was written is read from then
    on; else they stay until the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` and read it back."""
    path = path or new_folder(df.sparkSession, label)
    store(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later plan reads, by the file system it is on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
