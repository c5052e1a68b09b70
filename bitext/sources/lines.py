"""Aligned one-sentence-per-line files (SRC2) and their writer (SNK2, SNK3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import written

# How lines of documents become pairs of a parallel text.
LINE_ID_STRIDE = 1 << 32         # row_id = doc_id * stride + line number: no two lines share one
FUNCTION_WORDS = r"(^| )(the|of|is) "


def unquote_csv_line(col) -> Column:
    """Decode a line that a CSV writer quoted: drop the outer quotes and turn
    each doubled quote back into one."""
    c = F.col(col) if isinstance(col, str) else col
    quoted = F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.length(c) >= 2)
    inner = c.substr(F.lit(2), F.length(c) - F.lit(2))
    return F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(c)


def scanned_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """file, split (the byte offset where it begins), mid (ascending within a
    split, without gaps) and value of every line; without ``line_sep`` a line ends
    with a line feed, a carriage return or both."""
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    return reader.text(path).select(
        F.input_file_name().alias("file"),
        F.expr("input_file_block_start()").alias("split"),
        F.monotonically_increasing_id().alias("mid"),
        "value",
    )


def _with_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The scanned lines, and per split of a file the number of its lines and its first id."""
    raw = scanned_lines(spark, path)
    counts = raw.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    return raw, written(counts, "splits")


def _numbered(raw: DataFrame, splits: DataFrame, quoted: bool) -> DataFrame:
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    placed = raw.join(splits.select("file", "split", offset.alias("offset")), ["file", "split"])
    text = unquote_csv_line("value") if quoted else F.col("value")
    return placed.select("file", (F.col("mid") + F.col("offset")).alias("line_no"), text.alias("text"))


def read_lines(spark: SparkSession, path: str, quoted: bool = False) -> DataFrame:
    """``line_no`` (0-based over the file, or over a folder of part files in
    name order) and ``text``.

    A scan reads files in splits.  One aggregate counts the lines of each split,
    a prefix over the splits (a row each) tells the number of its first line, and
    a line's number is that plus its place in the split: no line is moved.
    """
    return _numbered(*_with_splits(spark, path), quoted)


def read_aligned(
    spark: SparkSession, src_path: str, tgt_path: str, corpus: str = "", quoted: bool = False
) -> DataFrame:
    """Zip two line files by line number (an equi-join, JOI1).  Raises when
    the two files do not have the same number of lines."""
    sides = [_with_splits(spark, path) for path in (src_path, tgt_path)]
    # line numbers are dense, so equal counts mean that every line has its partner
    counts = [splits.agg(F.sum("n")).first()[0] or 0 for _, splits in sides]
    if counts[0] != counts[1]:
        raise ValueError("aligned files have different line counts")
    s, t = (_numbered(*side, quoted).select("line_no", F.col("text").alias(name)) for side, name in zip(sides, ("src", "tgt")))
    return s.join(t, "line_no").select(F.col("line_no").alias("row_id"), F.lit(corpus).alias("corpus"), "src", "tgt")


def _aligned(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows by range of ``order``, checkpointed: every output written from it sees
    the same partitions, each in order."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint(eager=True)


def write_lines(df: DataFrame, path_prefix: str, sides=("src", "tgt"), order: str = "row_id") -> None:
    """SNK2: each side as raw lines (no CSV quoting), both files in the same
    row order.  The rows are dealt and sorted once, for both sides."""
    ordered = _aligned(df.select(order, *sides), [order])
    for side in sides:
        ordered.select(side).write.mode("overwrite").text(f"{path_prefix}.{side}")


def save_datasets(
    splits: DataFrame, out_dir: str, prefix: str, names=("train", "valid", "test"), sides=("src", "tgt")
) -> None:
    """SNK3: one dataset family: a Parquet table partitioned by split, a
    header CSV per split and the line files per split.

    The rows go through one range exchange by (split, row_id), are sorted and
    checkpointed, and every output is written from that: its part files follow
    each other in row order, and the line files of a split's sides are aligned
    line by line, part by part.  ``names`` are the splits that get files."""
    ordered = _aligned(splits, ["split", "row_id"])
    ordered.write.mode("overwrite").partitionBy("split").parquet(f"{out_dir}/{prefix}.parquet")
    for name in names:
        part = ordered.where(F.col("split") == name)
        part.select(*sides).write.mode("overwrite").option("header", "true").option(
            "escape", '"'
        ).csv(f"{out_dir}/{prefix}_{name}.csv")
        for side in sides:
            part.select(side).write.mode("overwrite").text(f"{out_dir}/{prefix}_{name}.{side}")
