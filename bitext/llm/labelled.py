"""Bounded labelled samples for the classifiers trained here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext.llm.common import held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled documents outside the
    held-out part, chosen by a hash of the id.  A document with several labels
    counts with the least, an id with several texts with the first of them in order;
    null ids and null labels are left out."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    # the label's ids first (small rows), at most ``bound`` of them; then their texts
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")
    # an id's rows: one of them, so that the bound holds for rows, too
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
