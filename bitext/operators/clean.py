"""Row filters and the cleaning pass (FLT1-5, STR7, UDF1).

All are narrow transformations: they run in the scan stage, and Catalyst
pushes the null checks into the Parquet reader.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def keep_where(df: DataFrame, cond: Column) -> DataFrame:
    """``df.where(cond)`` for a condition on *computed* columns.

    A plain filter is pushed below the projection that computes its columns,
    with the expressions copied into it, so a regex chain would run twice per
    row.  Evaluated as a generator (zero or one output row per input row) the
    condition reads the projected values instead: the projection and the
    check stay in one codegen stage and every expression runs once."""
    keep = F.when(cond, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    return df.withColumn("__keep", F.explode(keep)).drop("__keep")


def apply_text(df: DataFrame, cols: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """UDF1: apply a Column -> Column function to every listed text column."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def drop_null_pairs(df: DataFrame, cols=("src", "tgt")) -> DataFrame:
    """FLT1."""
    return df.na.drop(subset=list(cols))


def drop_empty_pairs(df: DataFrame, cols=("src", "tgt")) -> DataFrame:
    """FLT2 (null-safe: a null side is dropped as well)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & (F.col(c) != "")
    return keep_where(df, cond)  # a side may be computed


def clean_corpus(df: DataFrame, cols=("src", "tgt")) -> DataFrame:
    """STR7: drop null/empty pairs, clean every text column, drop pairs that
    became empty (the reference only filtered before cleaning)."""
    out = drop_empty_pairs(df, cols)
    out = apply_text(out, cols, tx.clean_text)
    nonempty = F.lit(True)
    for c in cols:
        nonempty = nonempty & (F.col(c) != "")
    return keep_where(out, nonempty)


def with_word_counts(df: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """STR13 + STR14: src_words, tgt_words, ratio = tgt / (src + 1e-9)."""
    return df.withColumns(
        {"src_words": tx.word_count(src), "tgt_words": tx.word_count(tgt)}
    ).withColumn("ratio", tx.word_ratio("tgt_words", "src_words"))


def min_words(df: DataFrame, k: int, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """FLT3: keep pairs with at least ``k`` words on both sides."""
    return keep_where(df, (tx.word_count(src) >= k) & (tx.word_count(tgt) >= k))


def ratio_filter(df: DataFrame, lo: float = 0.75, hi: float = 1.25) -> DataFrame:
    """FLT4: keep pairs whose word ratio lies in [lo, hi] (both inclusive)."""
    counted = df if "ratio" in df.columns else with_word_counts(df)
    return keep_where(counted, F.col("ratio").between(lo, hi))


def length_ratio_clean(
    df: DataFrame, src_tokens: str, tgt_tokens: str, lo: int = 2, hi: int = 350, ratio: float = 2.0
) -> DataFrame:
    """FLT5: token counts of both sides in [lo, hi] and longer/shorter <= ratio."""
    a, b = F.size(src_tokens), F.size(tgt_tokens)
    ok = a.between(lo, hi) & b.between(lo, hi) & (
        F.greatest(a, b).cast("double") <= F.lit(ratio) * F.least(a, b).cast("double")
    )
    return keep_where(df, ok)


def assert_fixed_length(df: DataFrame, col: str, length: int) -> DataFrame:
    """ARR5: raise if any array in ``col`` is not exactly ``length`` long
    (one bounded probe job: at most one offending row reaches the driver)."""
    bad = df.where(F.size(col) != length).select(F.size(col).alias("n")).limit(1).collect()
    if bad:
        raise ValueError(f"{col}: expected arrays of length {length}, found {bad[0]['n']}")
    return df
