"""Quoted CSV files with line breaks inside fields, read in splits (SRC1).

Spark's ``multiLine`` reader takes a file whole, in one task, as a line break may
lie inside quotes.  Whether it does depends on how many quotes stand before it in
the file, and of that only the parity counts:

1. a scan of the file's lines, in splits, adds up the quotes per split;
2. a prefix over the splits (a row each) tells for every split whether it begins
   inside quotes;
3. a running parity over a split's lines marks the lines that begin a record, and a
   prefix over the splits' numbers of records numbers them all;
4. lines of one record, also from two splits, are joined and parsed by ``from_csv``.

A file is well formed if quotes inside quoted fields are doubled and fields with
quotes or line breaks are quoted, as every CSV writer does; a lone quote would swallow
what follows, as it does in any reader.  Blank lines between records are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import written
from .lines import scanned_lines

_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def records(spark: SparkSession, path: str) -> DataFrame:
    """record_no (0-based, in file and line order over all files), first (whether it is
    a file's first record) and text, the record's lines."""
    lines = scanned_lines(spark, path, "\n")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.withColumn("quotes", quotes)
    splits = written(counted.groupBy("file", "split").agg(F.sum("quotes").alias("q")), "csv-splits")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = splits.select("file", "split", F.coalesce(F.sum("q").over(earlier), F.lit(0)).alias("before"))

    so_far = Window.partitionBy("file", "split").orderBy("mid")
    quotes_before = F.col("before") + F.coalesce(F.sum("quotes").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counted.join(inside, ["file", "split"]).withColumn("begins", (quotes_before % 2 == 0).cast("int"))
    numbered = begins.withColumn("nth", F.sum("begins").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = written(numbered.select("file", "split", "mid", "value", "nth"), "csv-lines")

    per_split = numbered.groupBy("file", "split").agg(F.max("nth").alias("n"))
    all_before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    of_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_split.select(
        "file", "split",
        F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("offset"),
        F.coalesce(F.sum("n").over(of_file), F.lit(0)).alias("in_file"),
    )
    placed = numbered.join(offsets, ["file", "split"])
    # a line that begins no record belongs to the last one before it, maybe of an earlier split
    whole = placed.groupBy((F.col("nth") + F.col("offset") - 1).alias("record_no")).agg(
        F.min(F.col("nth") + F.col("in_file")).alias("in_file"),
        F.sort_array(F.collect_list(F.struct("split", "mid", "value"))).alias("l"),
    )
    text = F.rtrim(F.array_join(F.transform("l", lambda x: x["value"]), "\n"), F.lit("\r"))
    return whole.select("record_no", (F.col("in_file") == 1).alias("first"), text.alias("text"))


def read_csv_in_splits(spark: SparkSession, path: str) -> DataFrame:
    """record_no and the file's columns, as strings, by their header names; every file
    under ``path`` has the same header."""
    header = spark.read.options(header="true", multiLine="true", **_OPTIONS).csv(path)
    names = header.columns
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = records(spark, path).where(~F.col("first") & (F.col("text") != ""))
    parsed = rows.select("record_no", F.from_csv("text", ddl, _OPTIONS).alias("r"))
    return parsed.select("record_no", *[F.col("r")[n].alias(n) for n in names])
