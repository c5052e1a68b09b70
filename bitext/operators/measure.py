"""Length measures, histograms, coverage, stage counts, ordering helpers
(STR13-14, AGG1-4, AGG8, SRT1-4).

Histograms are a ``groupBy(side, bin).count()`` whose partial aggregation
runs map-side, so a skewed length (every sentence 12 words long) costs no
more than any other; the bin spine is generated from one row with
``explode(sequence(..))``, never by a join of literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import row_positions


def _spine(df: DataFrame, sides: list[str], bins: int) -> DataFrame:
    one = df.sparkSession.range(1)
    return one.select(F.explode(F.array(*[F.lit(s) for s in sides])).alias("side")).select(
        "side", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )


def _long_lengths(df: DataFrame, length_cols: dict[str, str]) -> DataFrame:
    return df.select(
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("len")) for s, c in length_cols.items()])
        ).alias("x")
    ).select("x.side", "x.len")


def length_histogram(df: DataFrame, length_cols: dict[str, str], bins: int = 80, limit: int = 100) -> DataFrame:
    """AGG1: equal-width bins on [0, limit]; values above the limit are left
    out, the last bin is closed on the right.  Bin = (len * bins) div limit,
    exact in integer arithmetic."""
    vals = _long_lengths(df, length_cols).where(F.col("len").between(0, limit))
    b = F.least((F.col("len") * F.lit(bins)) / F.lit(limit), F.lit(bins - 1))
    counts = vals.groupBy("side", F.floor(b).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = _spine(df, list(length_cols), bins)
    return spine.join(counts, ["side", "bin"], "left").select(
        "side", "bin",
        (F.col("bin") * F.lit(float(limit)) / F.lit(bins)).alias("lo"),
        ((F.col("bin") + 1) * F.lit(float(limit)) / F.lit(bins)).alias("hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
    )


def length_histogram_auto(df: DataFrame, length_cols: dict[str, str], bins: int = 30) -> DataFrame:
    """AGG2: ``bins`` equal bins between each side's min and max length (a
    constant side puts everything into the middle bin)."""
    vals = _long_lengths(df, length_cols).where(F.col("len").isNotNull())
    rng = vals.groupBy("side").agg(F.min("len").alias("lo_all"), F.max("len").alias("hi_all"))
    # one row per side: AQE broadcasts it at run time
    width = F.col("hi_all") - F.col("lo_all")
    b = F.when(width == 0, F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col("len") - F.col("lo_all")) * F.lit(bins) / width), F.lit(bins - 1))
    )
    counts = vals.join(rng, "side").groupBy("side", b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    spine = _spine(df, list(length_cols), bins).join(rng, "side")
    w = F.col("hi_all") - F.col("lo_all")
    return spine.join(counts, ["side", "bin"], "left").select(
        "side", "bin",
        (F.col("lo_all") + F.col("bin") * w / F.lit(bins)).cast("double").alias("lo"),
        (F.col("lo_all") + (F.col("bin") + 1) * w / F.lit(bins)).cast("double").alias("hi"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
    )


def length_coverage(df: DataFrame, length_cols: dict[str, str], under: int = 30) -> DataFrame:
    """AGG4: share of sentences with fewer than ``under`` words, per side."""
    vals = _long_lengths(df, length_cols).where(F.col("len").isNotNull())
    return vals.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("len") < under).alias("n_under"),
        F.round(F.avg(F.when(F.col("len") < under, 1.0).otherwise(0.0)), 6).alias("share_under"),
        F.max("len").cast("long").alias("max_len"),
    )


def length_quantiles(
    df: DataFrame, length_cols: dict[str, str], quantiles: dict[str, float], approx: bool = False
) -> DataFrame:
    """AGG4: per side the number of sentences and the length at each quantile: the
    least length that a share ``q`` of the sentences does not exceed.

    Exact, from a histogram of lengths: sentences are counted per length in the scan
    tasks, and the running count goes over the distinct lengths alone.
    ``approx`` takes Spark's quantile sketch instead."""
    vals = _long_lengths(df, length_cols).where(F.col("len").isNotNull())
    if approx:
        cuts = [F.percentile_approx("len", q).cast("long").alias(name) for name, q in quantiles.items()]
        return vals.groupBy("side").agg(F.count(F.lit(1)).alias("n"), *cuts)
    counts = vals.groupBy("side", "len").agg(F.count(F.lit(1)).alias("k"))
    so_far = F.sum("k").over(Window.partitionBy("side").orderBy("len"))
    total = F.sum("k").over(Window.partitionBy("side"))
    placed = counts.select("side", "len", so_far.alias("so_far"), total.alias("n"))
    rank = lambda q: F.greatest(F.ceil(F.lit(float(q)) * F.col("n")), F.lit(1))
    cuts = [F.min(F.when(F.col("so_far") >= rank(q), F.col("len"))).cast("long").alias(name) for name, q in quantiles.items()]
    return placed.groupBy("side").agg(F.max("n").alias("n"), *cuts)


def max_length(cols: list[str]) -> Column:
    """AGG3/ARR3: the longest sequence over several columns (aggregate expr)."""
    return F.max(F.greatest(*[F.col(c) for c in cols]))


def positions_by(df: DataFrame, order: list, out: str = "pos") -> DataFrame:
    """Dense 0-based global position in ``order`` without one task holding
    all rows (range partitions + per-partition carry)."""
    return row_positions(df, [], order, out=out)


def skip_rows(df: DataFrame, n: int, order: list) -> DataFrame:
    """SRT3 ``rows[n:]`` in ``order`` (distributed; no single-partition
    OFFSET)."""
    return positions_by(df, order, "__pos").where(F.col("__pos") >= n).drop("__pos")


def top_k(df: DataFrame, k: int, order: list) -> DataFrame:
    """SRT3/SRT4 head/tail/top-k: the limit is the feature here."""
    return df.orderBy(*order).limit(k)
