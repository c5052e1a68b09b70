"""Seeded samples, splits and the three dataset recipes (SPL1-8, SET1, JOI2).

A draw is an order: rows sorted by ``stable_hash(seed, corpus, row_id)``
(ties by key).  "The first n rows of that order" is an exact-size sample
that does not depend on partitioning and is recomputed identically after
an executor loss.

The order is a uniform hash, so a cut after n rows needs no sort: rows are
counted by the upper half of the hash (at most 65,536 counters), the half that
holds the cut is counted by the lower half, and only rows of that one hash value
are looked at.  The cut is then a sort key, and every row is labelled by
comparing its own key with it: no text is shuffled.  Only ``draw_order``,
which wants every row's position, ranks all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash
from .positions import row_positions

KEY = ["corpus", "row_id"]


def draw_order(df: DataFrame, seed, out: str = "draw_pos") -> DataFrame:
    """SPL8 (shuffle): a repeatable permutation position per row."""
    h = df.withColumn("__h", stable_hash(seed, *KEY))
    return row_positions(h, [], ["__h", *KEY], out=out).drop("__h")


def _draw_key(df: DataFrame, seed) -> Column:
    return F.struct(stable_hash(seed, *KEY).alias("h"), *KEY)


def draw_cuts(df: DataFrame, seed, cuts: list[int]) -> list[Column | None]:
    """For each n in ``cuts`` the sort key of the first row after the first n of
    the draw order, as a literal; None where there is no such row."""
    keys = df.select(stable_hash(seed, *KEY).alias("h"), *KEY).persist()
    high = F.shiftright("h", 16)

    def find(counts: list, n: int):
        """The value that holds position n, and the position within it."""
        for value, rows in counts:
            if n < rows:
                return value, n
            n -= rows
        return None, n

    def counted(rows: DataFrame, by: Column) -> list:
        return sorted((r["v"], r["count"]) for r in rows.groupBy(by.alias("v")).count().collect())

    try:
        halves = counted(keys, high)
        found = []
        places = {n: find(halves, n) for n in set(cuts)}
        wanted = sorted({v for v, _ in places.values() if v is not None})
        low = counted(keys.where(high.isin(wanted)), F.col("h")) if wanted else []
        exact = {n: find([x for x in low if x[0] >> 16 == v], k) if v is not None else (None, k) for n, (v, k) in places.items()}
        hashes = sorted({v for v, _ in exact.values() if v is not None})
        # rows of one hash value of 2^32: a few
        rows = sorted((r["h"], r["corpus"], r["row_id"]) for r in keys.where(F.col("h").isin(hashes)).collect()) if hashes else []
        for n in cuts:
            value, k = exact[n]
            if value is None:
                found.append(None)
                continue
            h, corpus, row_id = [r for r in rows if r[0] == value][k]
            found.append(F.struct(F.lit(h).cast("long").alias("h"), F.lit(corpus).alias("corpus"), F.lit(row_id).cast("long").alias("row_id")))
        return found
    finally:
        keys.unpersist()


def _slices(df: DataFrame, seed, bounds: list[tuple[int, int, str]]) -> DataFrame:
    """Label rows by the slice [lo, hi) of the draw order that they lie in."""
    places = sorted({x for lo, hi, _ in bounds for x in (lo, hi)} - {0})
    cut = dict(zip(places, draw_cuts(df, seed, places)))
    key = _draw_key(df, seed)
    label = F.lit(None).cast("string")
    for lo, hi, name in bounds:
        if lo and cut[lo] is None:
            continue
        inside = (F.lit(True) if not lo else key >= cut[lo]) & (F.lit(True) if cut.get(hi) is None else key < cut[hi])
        if hi > lo:
            label = F.when(inside, F.lit(name)).otherwise(label)
    return df.withColumn("split", label)


def sample_exact(df: DataFrame, n: int, seed) -> DataFrame:
    """SPL2: exactly ``min(n, count)`` rows."""
    return _slices(df, seed, [(0, n, "in")]).where(F.col("split") == "in").drop("split") if n > 0 else df.limit(0)


def remaining(df: DataFrame, taken: DataFrame) -> DataFrame:
    """JOI2: rows of ``df`` not in ``taken``, by the (corpus, row_id) key."""
    return df.join(taken.select(*KEY), KEY, "left_anti")


def split_counts(df: DataFrame, seed, sizes: list[int], names: list[str]) -> DataFrame:
    """Consecutive slices of the draw order: names[i] gets sizes[i] rows;
    rows after the last slice are dropped (SPL4)."""
    bounds, acc = [], 0
    for n, name in zip(sizes, names):
        bounds.append((acc, acc + n, name))
        acc += n
    return _slices(df, seed, bounds).where(F.col("split").isNotNull())


def test_size(n: int, fraction: float) -> int:
    """Test rows for a fractional split: ceil(fraction * n)."""
    return int(math.ceil(fraction * n))


def split_fraction(df: DataFrame, fraction: float, seed, names=("train", "test")) -> DataFrame:
    """SPL1: ``train_test_split(test_size=fraction)``; test gets
    ceil(fraction * n) rows, train the rest."""
    n = df.count()
    n_test = test_size(n, fraction)
    return split_counts(df, seed, [n_test, n - n_test], [names[1], names[0]])


def split_half(df: DataFrame, seed, names=("valid", "test")) -> DataFrame:
    """SPL3: test_size=0.5."""
    return split_fraction(df, 0.5, seed, names)


def recipe_set1(a: DataFrame, b: DataFrame, seed) -> DataFrame:
    """SPL5: train = all of A; valid/test = halves of B."""
    return a.withColumn("split", F.lit("train")).unionByName(split_half(b, seed))


def recipe_set2(a: DataFrame, b: DataFrame, seed, n_valid: int, n_test: int) -> DataFrame:
    """SPL6: train = all B + |B| rows of A; valid/test = absolute sizes from
    the rest of A.

    The rest of A in draw order is the draw order of A after its first |B|
    rows, so one positions pass over A labels all three slices (no anti-join,
    no second draw)."""
    n_a, n_b = a.count(), b.count()
    if n_b + n_valid + n_test > n_a:
        raise ValueError(f"{n_a} rows cannot give {n_b} + {n_valid} + {n_test}")
    sliced = split_counts(a, seed, [n_b, n_valid, n_test], ["train", "valid", "test"])
    return b.withColumn("split", F.lit("train")).unionByName(sliced)


def recipe_set3(a: DataFrame, b: DataFrame, seed, n_a: int, n_b: int) -> DataFrame:
    """SPL7: train = n_a of A + n_b of B; valid = rest of A; test = rest of B."""

    def first_or(df: DataFrame, n: int, rest: str) -> DataFrame:
        label = F.coalesce(F.col("split"), F.lit(rest))
        return _slices(df, seed, [(0, n, "train")]).withColumn("split", label)

    return first_or(a, n_a, "valid").unionByName(first_or(b, n_b, "test"))


def union_corpora(*dfs: DataFrame) -> DataFrame:
    """SET1."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out
