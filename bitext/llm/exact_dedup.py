"""Exact dedup against a minimal perfect hash of earlier digests.

A text's digest is SHA-256 of its ASCII-lower-cased UTF-8.  The distinct
digests of the *history* are dealt into buckets of bounded size (uniform,
as digests are distinct); each bucket becomes one perfect hash whose slots
hold the full digest and the winner's locator.  New rows are first reduced
to one record per distinct digest (map-side combine, so a text that is a
third of all rows is one record), then looked up in the bucket's hash with
a byte comparison: members are repeats of history, nonmembers form groups
of their own.  The largest id of a group wins.

Edge cases: null text counts as empty; a null id loses to any other and
groups like one; among rows equal in id and text one (any, but fixed once the
digest table is written) is kept; empty tables give empty results; further
columns are never read."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext.llm.common import ascii_lower, fresh, stored, text_of
from bitext.llm.perfect_hash import DIGEST_BYTES, PerfectHash, as_words

KEYS_PER_BUCKET = 16384

_RECORD = "digest binary, doc_id long, uid long, n_same long, n long"
_INDEX = "bucket long, sizes array<int>, bits binary, digests binary, locators binary, null_ids binary"


def digest_of(text_col: str) -> Column:
    return F.unhex(F.sha2(ascii_lower(text_of(text_col)), 256))


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, uid, digest), written once; ``uid`` tells equal rows apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(text_col).alias("digest"))
    return stored(rows.withColumn("uid", F.monotonically_increasing_id()), "digests")


def winners(digests: DataFrame) -> DataFrame:
    """One record per distinct digest: the winning row, how many rows share
    its id (n_same) and the size of the group (n)."""
    by_id = digests.groupBy("digest", "doc_id").agg(F.max("uid").alias("uid"), F.count("*").alias("n_same"))
    best = F.max(F.struct("doc_id", "uid", "n_same"))
    return (
        by_id.groupBy("digest")
        .agg(best.alias("w"), F.sum("n_same").alias("n"))
        .select("digest", "w.doc_id", "w.uid", "w.n_same", "n")
    )


def _bucket(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).alias("bucket")


def build_index(records: DataFrame, n_buckets: int) -> DataFrame:
    """One row per bucket: the perfect hash and its slots."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        words = as_words(list(pdf["digest"]))
        made, slot = PerfectHash.build(words)
        order = np.argsort(slot)
        ids = pdf["doc_id"]
        loc = np.stack([c.fillna(0).to_numpy(np.int64) for c in (ids, pdf["uid"], pdf["n_same"], pdf["n"])], 1)
        sizes, bits = made.dump()
        return pd.DataFrame(
            [[int(pdf["bucket"].iloc[0]), sizes, bits, words[order].tobytes(), loc[order].tobytes(),
              ids.isna().to_numpy()[order].tobytes()]],
            columns=["bucket", "sizes", "bits", "digests", "locators", "null_ids"],
        )

    return records.select(_bucket(n_buckets), "*").groupBy("bucket").applyInPandas(build, _INDEX)


def _merge(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Members take their slot's record into account, nonmembers stand alone;
    slots that no new record met come out as they are."""
    cols = ["digest", "doc_id", "uid", "n_same", "n"]
    if not len(index):
        return new[cols]
    row = index.iloc[0]
    slots = np.frombuffer(row["digests"], "<u8").reshape(-1, DIGEST_BYTES // 8)
    loc = np.frombuffer(row["locators"], np.int64).reshape(-1, 4)
    old = pd.DataFrame(loc.copy(), columns=cols[1:])
    old["doc_id"] = old["doc_id"].astype("Int64").mask(np.frombuffer(row["null_ids"], bool))
    raw = row["digests"]
    old.insert(0, "digest", [raw[i : i + DIGEST_BYTES] for i in range(0, len(raw), DIGEST_BYTES)])
    if not len(new):
        return old
    new = new[cols].reset_index(drop=True)
    new["doc_id"] = new["doc_id"].astype("Int64")
    words = as_words(list(new["digest"]))
    at = PerfectHash.load(row["sizes"], row["bits"]).slots(words)
    member = at >= 0
    member[member] = (slots[at[member]] == words[member]).all(axis=1)  # byte check
    here, there = new[member].reset_index(drop=True), old.iloc[at[member]].reset_index(drop=True)
    a, b = here["doc_id"].fillna(-(2**63)), there["doc_id"].fillna(-(2**63))
    same = (a == b) & (here["doc_id"].isna() == there["doc_id"].isna())
    newer = (a > b) | (same & (here["uid"] > there["uid"])) | (here["doc_id"].notna() & there["doc_id"].isna())
    both = here.where(newer, there)
    both["n_same"] = both["n_same"].where(~same, here["n_same"] + there["n_same"])
    both["n"] = here["n"] + there["n"]
    untouched = np.ones(len(old), bool)
    untouched[at[member]] = False
    return pd.concat([both, new[~member], old[untouched]])


def decisions(digests: DataFrame, history: Column | None = None) -> DataFrame:
    """One record per distinct digest of the whole table, winners found by
    looking the rows outside ``history`` up in the history's perfect hash.
    ``history`` is a condition over the digest table; by default the lower half
    of the id range, as if an earlier crawl had delivered it."""
    if history is None:
        lo, hi = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
        history = F.col("doc_id") <= F.lit(None if lo is None else (lo + hi) // 2)
    history = F.coalesce(history, F.lit(False))
    old = stored(winners(digests.filter(history)), "history")
    new = stored(winners(digests.filter(~history)), "new")
    n_buckets = max(1, -(-max(old.count(), new.count()) // KEYS_PER_BUCKET))
    index = stored(build_index(old, n_buckets), "hash-index")
    merged = (
        new.select(_bucket(n_buckets), "*")
        .groupBy("bucket")
        .cogroup(index.groupBy("bucket"))
        .applyInPandas(_merge, _RECORD)
    )
    return merged


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row per row of ``docs``."""
    digests = digest_table(docs, id_col, text_col)
    best = stored(decisions(digests), "winners").select(
        "digest", F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"), F.col("n").alias("group_size")
    )
    return digests.join(best, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "digest"
    )


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with all their columns."""
    best = decisions(digest_table(docs, id_col, text_col))

    # digest and id together: a hot text's copies spread over all tasks
    def key(digest: Column, doc_id: Column) -> Column:
        return F.concat(digest, F.coalesce(F.hex(doc_id.cast("long")), F.lit("")).cast("binary"))

    name = fresh(docs, "row_key")
    keep = best.select(key(F.col("digest"), F.col("doc_id")).alias(name))
    hit = docs.withColumn(name, key(digest_of(text_col), F.col(id_col))).join(keep, name, "left_semi")
    pick = fresh(docs, "row_pick")
    nth = F.row_number().over(Window.partitionBy(name).orderBy(name))
    return hit.withColumn(pick, nth).filter(F.col(pick) == 1).drop(name, pick)
