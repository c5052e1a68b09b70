"""Streaming form of the stateless cleaning pass.

The reference is batch-only.  Its cleaning steps, length measures and ratio
band are stateless column expressions, so the same code accepts a streaming
DataFrame: new files of text arriving in a folder are cleaned and filtered
as micro-batches, with exactly-once output through a checkpointed file sink.
No state store is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import clean as cl
from ..sources.lines import FUNCTION_WORDS, LINE_ID_STRIDE

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def line_pairs(docs: DataFrame) -> DataFrame:
    """Documents -> one row per line (row_id as in the batch fixture),
    the same derivation as the batch fixture."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "tgt"))
    return lines.select(
        (F.col("doc_id") * LINE_ID_STRIDE + F.col("line_no")).alias("row_id"),
        F.regexp_replace("tgt", FUNCTION_WORDS, "$1").alias("src"),
        "tgt",
    )


def cleaned_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of cleaned, ratio-banded pairs from parquet files
    of documents arriving in ``source_dir``."""
    reader = spark.readStream.schema(DOCUMENT_SCHEMA)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = reader.parquet(source_dir)
    return cl.ratio_filter(cl.with_word_counts(cl.clean_corpus(line_pairs(docs))))


def start_clean_stream(
    spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str, trigger_once: bool = False
) -> StreamingQuery:
    """Write the cleaned stream as parquet; the checkpoint folder must be on
    shared storage so a restarted driver resumes where it stopped."""
    w = (
        cleaned_stream(spark, source_dir)
        .writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
    )
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
