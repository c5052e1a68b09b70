"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept; its output is written as Parquet and read back as the next
one's docs.  All but the last return the columns of documents, all of them, whatever
their names.

Edge cases of every stage: a null text counts as empty and is judged like one; a null
doc_id stays unless its text goes; rows with equal ids are rows of their own; an empty
table gives an empty one, with the stage's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext.llm import bpe_codec, decontaminate, exact_dedup, quality, simhash
from bitext.llm.common import stored
from bitext.sources.tables import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier accepts; it learns from the labelled rows of
    ``docs`` outside the held-out part.  A text like none of them gets their mean
    label; without any of them every score is 0.5, so no row is accepted."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (A-Z folded) the one with the largest doc_id, null ids
    last; of rows that are equal in id and text one stays."""
    return exact_dedup.first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose fingerprints are linked (at most 4 differing bits, over any number of
    steps) the one with the least doc_id, null ids last, then the least text hash.  Texts
    without words share the fingerprint zero."""
    return simhash.one_of_each(docs, shingle=4, radius=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of which less than a twentieth of the words lies in a benchmark window;
    rows without words stay, and so do all without a benchmark."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the text's token ids (little-endian, 4 bytes each) with their number and
    digest, and the digest of the bytes that they decode to; an empty text has no ids."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe_codec.with_ids(docs.select("doc_id", "text"), path, pattern, decoded="bytes").select(
        "doc_id",
        bpe_codec.n_ids().alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: The classifier is trained here, which SQL cannot say; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
