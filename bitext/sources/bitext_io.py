"""Bitext sources and sinks (SRC1-7, SNK1-5).

A bitext table has the columns ``row_id BIGINT, corpus STRING, src STRING,
tgt STRING``.  Row identity is an explicit key, never row order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import ratio_filter, with_word_counts
from .split_csv import read_csv_in_splits

BITEXT_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        T.StructField("corpus", T.StringType(), True),
        T.StructField("src", T.StringType(), True),
        T.StructField("tgt", T.StringType(), True),
    ]
)


def check_columns(df: DataFrame, columns: Iterable[str]) -> None:
    """SRC5: raise ``ValueError`` naming every missing column."""
    wanted = list(columns)
    absent = sorted(set(wanted) - set(df.columns))
    if absent:
        raise ValueError(f"table lacks {absent}; it has {df.columns}")


def _csv_reader(spark: SparkSession, schema: T.StructType | None = None, multi_line: bool = True):
    reader = (
        spark.read.option("header", "true")
        .option("multiLine", str(multi_line).lower())
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
    )
    return reader.schema(schema) if schema is not None else reader


def read_bitext_csv(
    spark: SparkSession,
    path: str,
    src_col: str,
    tgt_col: str,
    corpus: str,
    id_col: str | None = None,
    na_values: Iterable[str] = (),
    multi_line: bool = True,
    in_splits: bool = False,
) -> DataFrame:
    """SRC1 + SRC4: read a two-column CSV (quoted, embedded commas and
    newlines) and map its columns to ``src``/``tgt``.

    Without an id column the row id is Spark's monotonically increasing id
    of the scan: unique and increasing in file order, not dense, and different
    when the file is split differently; name an id column where draws must
    repeat.  ``na_values``: further strings that count as null.
    ``multi_line=False`` lets a large file without embedded newlines be split;
    ``in_splits`` reads one with embedded newlines in many tasks
    (``split_csv``), and the row id is then the number of the record."""
    # no schema: every column is read as a string under its header name, so
    # the file's column order does not matter (a positional schema would)
    df = read_csv_in_splits(spark, path) if in_splits else _csv_reader(spark, multi_line=multi_line).csv(path)
    check_columns(df, [src_col, tgt_col] + ([id_col] if id_col else []))
    number = F.col("record_no") if in_splits else F.monotonically_increasing_id()
    rid = F.col(id_col).cast("long") if id_col else number
    gone = list(na_values)

    def side(name: str):
        return F.when(~F.col(name).isin(gone), F.col(name)) if gone else F.col(name)

    return df.select(
        rid.alias("row_id"), F.lit(corpus).alias("corpus"), side(src_col).alias("src"), side(tgt_col).alias("tgt")
    )


def rename_sides(df: DataFrame, src_col: str, tgt_col: str) -> DataFrame:
    """SRC4: column rename at ingestion."""
    check_columns(df, [src_col, tgt_col])
    return df.withColumnsRenamed({src_col: "src", tgt_col: "tgt"})


def read_results_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC6: experiment CSV; ragged lines are kept in ``_corrupt_record``."""
    full = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType(), True)])
    return (
        spark.read.option("header", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .schema(full)
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK1/SNK5: header CSV; ``row_id`` is an ordinary column if present."""
    df.write.mode(mode).option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def save_by_ratio(df: DataFrame, path: str, lo: float = 0.75, hi: float = 1.25) -> None:
    """SRT2: keep the pairs whose word ratio lies in [lo, hi], sort them by falling ratio
    (Spark's range exchange; part files follow each other in that order) and write
    them as CSV with their row id, word counts and ratio."""
    kept = ratio_filter(with_word_counts(df), lo, hi)
    write_csv(kept.orderBy(F.col("ratio").desc(), "row_id"), path)


def append_results(df: DataFrame, path: str) -> None:
    """SNK4: append result rows to a Parquet table."""
    df.write.mode("append").parquet(path)


def append_results_csv(df: DataFrame, path: str) -> None:
    """SNK4 as CSV: every part file opens with the header, which readers of
    the folder (``header=true``) take once; values are quoted as in SNK1."""
    write_csv(df, path, mode="append")


def profile(df: DataFrame) -> DataFrame:
    """SRC7: row count and non-null count per column, with its type."""
    aggs = [F.count(F.lit(1)).alias("__rows")] + [F.count(F.col(c)).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', '{t}', `{c}`" for c, t in df.dtypes)
    return wide.selectExpr(
        "__rows AS n_rows", f"stack({len(df.columns)}, {stack}) AS (column_name, data_type, non_null)"
    )
