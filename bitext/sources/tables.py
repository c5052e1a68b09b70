"""Parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SPREAD = "spark.bitext.spreadSmallScans"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a scan by ``key`` where the session asks for it.

    One big row group is one task; a laptop session over small single-file
    tables sets ``spark.bitext.spreadSmallScans`` to use all of its cores.  The
    setting is off by default: on a large input the scan has splits enough and
    a plan never depends on sizes or on the cluster."""
    if df.sparkSession.conf.get(SPREAD, "false") != "true":
        return df
    return df.repartition(key)
