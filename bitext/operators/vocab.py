"""Vocabularies, encoding and decoding (AGG5-7, ARR1, ARR7, FLT9-10, JOI4).

A vocabulary is a table ``(token, freq, id)``.  Building it is one
``groupBy(token)`` (partial aggregation absorbs very frequent tokens) and a
dense position in (freq desc, token asc) order: a top-k where the vocabulary is
capped, ``positions.row_positions`` where it is not.  Encoding partitions the
compact rows by key once.  A vocabulary whose id space is capped
(``max_tokens``, at most ``BROADCAST_TOKENS``) is broadcast, and the tokens of
whole batches of rows are looked up in the task: none becomes a row of its own.
Otherwise token positions are exploded, joined and regrouped by the row key, and
the join is left to AQE (a sort-merge join that splits the partitions of very
frequent tokens).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import FIRST_TOKEN_ID, PAD_ID, UNK_ID
from .positions import desc, row_positions
from .rows import Tokens, lists, map_rows, words_of

BROADCAST_TOKENS = 200_000
_HELD = 1_000_000  # distinct tokens, and their counts, that a task holds


def token_counts(df: DataFrame, tokens_col: str | Sequence[str]) -> DataFrame:
    """token, freq; of one column or of several together.  Columns of texts (words one space
    apart) are cut and counted in the task first."""
    cols = [tokens_col] if isinstance(tokens_col, str) else list(tokens_col)
    df = df.select(*cols)
    if all(isinstance(f.dataType, T.StringType) for f in df.schema):
        counts = df.mapInArrow(_counted, "token string, n long")
        return counts.groupBy("token").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("freq"))
    tokens = F.explode(cols[0] if len(cols) == 1 else F.concat(*[F.coalesce(c, F.array()) for c in cols]))
    return df.select(tokens.alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of texts; batches with many tokens in common are added up."""
    held: list[pa.Table] = []

    def added() -> pa.Table:
        table = pa.concat_tables(held).group_by("token").aggregate([("n", "sum")])
        return pa.table({"token": table["token"], "n": table["n_sum"]})

    for b in batches:
        for texts in b.columns:
            found = pc.value_counts(words_of(texts).flatten())
            held.append(pa.table({"token": found.field("values").cast(pa.string()), "n": found.field("counts")}))
        if sum(len(t) for t in held) > _HELD:
            held = [added()]
            if len(held[0]) > _HELD // 2:
                yield from held[0].combine_chunks().to_batches()
                held = []
    if held:
        yield from added().combine_chunks().to_batches()


def build_vocab(
    df: DataFrame, tokens_col: str | Sequence[str], first_id: int = FIRST_TOKEN_ID, max_tokens: int | None = None
) -> DataFrame:
    """AGG5 (ids from 2: 0 pad, 1 unk) or AGG6 (``first_id=1``): ids by
    falling frequency, ties by token; ``max_tokens`` caps the id space
    (ids 0 .. max_tokens - 1) like a vectoriser's ``max_tokens``."""
    counts = token_counts(df, tokens_col)
    if max_tokens is not None and max_tokens <= BROADCAST_TOKENS:
        # the cap is the feature: a top-k, and a window over at most ``max_tokens`` rows
        by = [F.col("freq").desc(), F.col("token").asc()]
        top = counts.orderBy(*by).limit(max(0, max_tokens - first_id))
        return top.select("token", "freq", (F.row_number().over(Window.orderBy(*by)) + (first_id - 1)).cast("int").alias("id"))
    ranked = row_positions(counts, [], [desc("freq"), "token"], out="rank")
    out = ranked.select("token", "freq", (F.col("rank") + first_id).cast("int").alias("id"))
    return out if max_tokens is None else out.where(F.col("id") < max_tokens)


def encode(
    df: DataFrame,
    key: list[str],
    tokens_col: str | Sequence[str],
    vocab: DataFrame,
    out: str | Sequence[str] = "ids",
    drop_oov: bool = False,
    max_tokens: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """ARR1 (unknown -> 1) or FLT9 (``drop_oov``: unknown tokens removed).
    Returns ``key`` columns plus ``out`` (array<int> in token order), a row per key
    (of a key with several rows: their tokens by position).
    ``max_tokens``: the cap that the vocabulary was built with, if any.
    ``unique``: the caller's word that keys are, so that no row moves.
    With a broadcast vocabulary several columns, as many as ``out`` names, are encoded at once, and texts of
    words one space apart may stand for arrays."""
    if _small(max_tokens):
        cols, outs = _columns(tokens_col, out)
        ids = [T.StructField(x, T.ArrayType(T.IntegerType())) for x in outs]
        return map_rows(df, key, {c: F.col(c) for c in cols}, _each(_ids_of(vocab, drop_oov), cols), ids, unique=unique)
    placed = df.select(*key, tokens_col).repartition(*key)
    exploded = placed.select(*key, F.posexplode_outer(tokens_col).alias("pos", "token"))
    joined = exploded.join(vocab.select("token", "id"), "token", "left")
    idv = F.coalesce(F.col("id"), F.lit(UNK_ID))
    keep = F.col("pos").isNotNull()
    if drop_oov:
        keep = keep & F.col("id").isNotNull()
    entry = F.when(keep, F.struct(F.col("pos"), idv.alias("id")))
    grouped = joined.groupBy(*key).agg(F.collect_list(entry).alias("__e"))
    return grouped.select(*key, F.transform(F.array_sort("__e"), lambda e: e["id"]).alias(out))


def _small(max_tokens: int | None) -> bool:
    return max_tokens is not None and max_tokens <= BROADCAST_TOKENS


def _held(vocab: DataFrame):
    """A capped vocabulary, broadcast: its tokens and their ids."""
    rows = vocab.select("token", "id").where(F.col("token").isNotNull()).collect()
    held = pa.array([r.token for r in rows], pa.string()), np.array([r.id for r in rows], np.int64)
    return vocab.sparkSession.sparkContext.broadcast(held)


def _columns(cols: str | Sequence[str], out: str | Sequence[str]) -> tuple[list[str], list[str]]:
    return ([cols], [out]) if isinstance(cols, str) else (list(cols), list(out))


def _each(fn, cols: Sequence[str]):
    """``fn`` on every one of the columns."""
    return lambda rows: [fn(rows, c) for c in cols]


def _ids_of(vocab: DataFrame, drop_oov: bool):
    shared = _held(vocab)

    def run(rows: pa.ListArray, col: str) -> pa.Array:
        tokens, ids = shared.value
        t = Tokens(rows, col)
        at = pc.fill_null(pc.index_in(t.values, value_set=tokens), -1).to_numpy()
        found = np.append(ids, UNK_ID)[at]  # -1: the last one
        order = t.order(found)
        if drop_oov:
            order = order[at[order] >= 0]
        return lists(t.group[order], t.groups, pa.array(found[order], pa.int32()))

    return run


def _texts_of(vocab: DataFrame, skip_ids: Sequence[int]):
    shared = _held(vocab)

    def run(rows: pa.ListArray, col: str) -> pa.Array:
        tokens, ids = shared.value
        where = np.full(ids.max(initial=0) + 1, -1)
        where[ids] = np.arange(len(ids))
        where[[i for i in skip_ids if 0 <= i < len(where)]] = -1
        t = Tokens(rows, col)
        wanted = pc.fill_null(t.values, -1).to_numpy()
        at = np.where((wanted >= 0) & (wanted < len(where)), where[np.clip(wanted, 0, len(where) - 1)], -1)
        rank = at
        if t.repeated:  # rows of one key: tokens of a position by their bytes
            by_bytes = np.empty(len(tokens) + 1, np.int64)
            by_bytes[sorted(range(len(tokens)), key=lambda i: tokens[i].as_py().encode())] = np.arange(len(tokens))
            rank = by_bytes[at]
        order = t.order(rank)
        order = order[at[order] >= 0]
        words = lists(t.group[order], t.groups, tokens.take(pa.array(at[order], pa.int64())))
        return pc.binary_join(words, " ")

    return run


def decode(
    df: DataFrame,
    key: list[str],
    ids_col: str | Sequence[str],
    vocab: DataFrame,
    out: str | Sequence[str] = "text",
    skip_ids=(PAD_ID,),
    max_tokens: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """ARR7/FLT10/STR15: ids -> words joined by one space; skipped ids and
    ids missing from the vocabulary are left out.  ``max_tokens``, ``unique`` and several
    columns: as in ``encode``."""
    # skipped ids (padding is most of them) go before the explode; a sequence
    # of only skipped ids still yields its key (with an empty text)
    kept = lambda c: F.filter(c, lambda x: ~x.isin(list(skip_ids)))
    if _small(max_tokens):
        cols, outs = _columns(ids_col, out)
        texts = [T.StructField(x, T.StringType()) for x in outs]
        skip = skip_ids if unique else ()  # rows of one key are put together by positions among the kept
        kept_ids = df.select(*key, *[(F.col(c) if unique else kept(c)).alias(c) for c in cols])
        return map_rows(kept_ids, key, {c: F.col(c) for c in cols}, _each(_texts_of(vocab, skip), cols), texts, unique=unique)
    placed = df.select(*key, kept(ids_col).alias("__ids")).repartition(*key)
    exploded = placed.select(*key, F.posexplode_outer("__ids").alias("pos", "id"))
    joined = exploded.join(vocab.select("id", "token"), "id", "left")
    entry = F.when(F.col("token").isNotNull(), F.struct("pos", "token"))
    grouped = joined.groupBy(*key).agg(F.collect_list(entry).alias("__e"))
    return grouped.select(
        *key, F.array_join(F.transform(F.array_sort("__e"), lambda e: e["token"]), " ").alias(out)
    )


def dictionary_report(splits: DataFrame, sides: dict[str, str], train: str = "train") -> DataFrame:
    """AGG7: per (split, side): sentences, tokens (words + one end mark per
    sentence), tokens missing from that side's train vocabulary and their
    percentage, and the train vocabulary size.

    ``splits`` has a ``split`` column and one token-array column per side."""
    long = splits.select(
        "split",
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("toks")) for s, c in sides.items()])
        ).alias("x"),
    ).select("split", "x.side", "x.toks")
    # one record per (split, side, token): the raw token stream is read and shuffled once,
    # combined map-side, so a very frequent token is a row per task.  After its tokens
    # every sentence has an end mark (kind 1); one without an array (kind 2) counts as a sentence only
    marked = F.posexplode_outer(F.concat("toks", F.array(F.lit(None).cast("string")))).alias("pos", "token")
    kind = F.when(F.col("pos").isNull(), 2).when(F.col("pos") == F.col("size"), 1).otherwise(0)
    counts = (
        long.select("split", "side", F.size("toks").alias("size"), marked)
        .groupBy("split", "side", "token", kind.alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = F.max(F.col("split") == train).over(Window.partitionBy("side", "token", "kind"))
    word, n = F.col("kind") == 0, F.col("n")
    out = (
        counts.withColumn("known", known)  # as many rows as there are splits
        .groupBy("split", "side")
        .agg(
            F.sum(F.when(F.col("kind") > 0, n)).alias("sents"),
            F.sum(F.when(F.col("kind") < 2, n)).cast("long").alias("tokens"),
            F.sum(F.when(word & ~F.col("known"), n)).alias("n_unk"),
            F.sum(F.when(word & (F.col("split") == train), 1).otherwise(0)).alias("own"),
        )
        .withColumn("types", F.sum("own").over(Window.partitionBy("side")))
    )
    n_unk = F.coalesce(F.col("n_unk"), F.lit(0)).cast("long")
    return out.select(
        "split", "side", "sents", "tokens", n_unk.alias("n_unk"),
        F.round(n_unk * 100.0 / F.col("tokens"), 2).alias("unk_pct"),
        F.coalesce(F.col("types"), F.lit(0)).cast("long").alias("types"),
    )
