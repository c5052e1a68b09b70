"""Batches of consecutive rows and back (ARR9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import row_positions


def with_batch(df: DataFrame, order: list, size: int, drop_remainder: bool = False, out: str = "batch") -> DataFrame:
    """Number the batch of each row: ``size`` consecutive rows in ``order``.
    ``drop_remainder`` leaves out a last batch that is not full."""
    placed = row_positions(df, [], order, out="__pos")
    if drop_remainder:
        placed = placed.where(F.col("__pos") < df.count() // size * size)
    return placed.withColumn(out, F.expr(f"__pos div {int(size)}")).withColumn("__at", F.expr(f"__pos % {int(size)}")).drop("__pos")


def batch(df: DataFrame, order: list, size: int, drop_remainder: bool = False) -> DataFrame:
    """One row per batch: its number and ``rows``, at most ``size`` structs in order."""
    row = F.struct("__at", *[F.col(c) for c in df.columns])
    numbered = with_batch(df, order, size, drop_remainder)
    return numbered.groupBy("batch").agg(F.sort_array(F.collect_list(row)).alias("rows"))


def unbatch(batches: DataFrame) -> DataFrame:
    """The rows of ``batch``'s output."""
    return batches.select(F.explode("rows").alias("r")).select("r.*").drop("__at")
