"""Running aggregates and row positions per key without a task per key.

``Window.partitionBy(key)`` puts every row of a key into one task, which is
what a hot key (a third of all rows) cannot afford.  Instead:

1. Spark's own range exchange deals the rows by ``(keys, order)`` into as many
   buckets as the row count asks for, each is sorted, and the result is written
   once to the shared folder: with the number of its bucket and its place in it.
   A hot key spans many buckets, and every branch of a plan reads the same ones.
2. One row per (bucket, key) says how many rows there are and where they begin.
   Only the first key of a bucket can have rows in earlier buckets, so the
   carry-in from them is a prefix over at most one row per bucket and key.
3. A position is the row's place in its bucket, less the key's first place in it,
   plus the carry-in: no window over rows at all.  Other running values are a window over
   ``(bucket, keys)``, bounded by the bucket's size, combined with the carry-in.

Supported running functions: count, sum, min, max, each with an inclusive
or exclusive (rows strictly before) frame.  ``order`` items are column
names (ascending) or ``desc(name)``; nulls come first either way.

The input is written once before it is dealt, as a range exchange reads its
input twice; ``scan=True`` says that reading it twice costs no more than that."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import new_folder, remove, written

_B, _AT = "__bucket", "__at"
ROWS_PER_BUCKET = 250_000
BROADCAST_BUCKETS = 1_000_000  # a row per bucket, 24 bytes, is broadcast up to here


@dataclass(frozen=True)
class Running:
    out: str
    func: str            # 'count' | 'sum' | 'min' | 'max'
    col: str | None = None
    inclusive: bool = True


@dataclass(frozen=True)
class desc:  # noqa: N801  (reads like a sort keyword at call sites)
    name: str


_AGG = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_COMBINE = {"sum": "sum", "count": "sum", "min": "min", "max": "max"}


def _value(spec: Running) -> Column:
    return F.lit(1) if spec.func == "count" else F.col(spec.col)


def _sorted_by(order: list) -> list[Column]:
    return [F.col(o.name).desc_nulls_first() if isinstance(o, desc) else F.col(o).asc_nulls_first() for o in order]


def with_buckets(
    df: DataFrame, keys: list[str], order: list, buckets: int | None = None, scan: bool = False
) -> DataFrame:
    """The rows with ``__bucket``, an order-preserving range of (keys, order), and
    ``__at``, the row's place in it; written."""
    spark = df.sparkSession
    source = None
    if not scan:
        source = new_folder(spark, "unordered")
        df = written(df, "unordered", source)
    n = buckets or max(1, -(-df.count() // ROWS_PER_BUCKET))
    by = _sorted_by([*keys, *order])
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    # Spark's row id: the partition's number above 33 bits, the row's place in it below
    place = F.monotonically_increasing_id()
    dealt = dealt.withColumn("__id", place).withColumns(
        {_B: F.shiftright("__id", 33).cast("int"), _AT: F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    out = written(dealt.drop("__id"), "ordered")
    if source is not None:
        remove(spark, source)
    return out


def _same_group(keys: list[str]) -> list[Column]:
    return [F.col(_B) == F.col("__cb")] + [F.col(k).eqNullSafe(F.col(f"__ck_{i}")) for i, k in enumerate(keys)]


def _group_columns(keys: list[str]) -> list[Column]:
    return [F.col(_B).alias("__cb"), *[F.col(k).alias(f"__ck_{i}") for i, k in enumerate(keys)]]


def _without_group(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.drop("__cb", *[f"__ck_{i}" for i in range(len(keys))])


def running(
    df: DataFrame,
    keys: list[str],
    order: list,
    specs: list[Running],
    buckets: int | None = None,
    scan: bool = False,
) -> DataFrame:
    """Add one column per spec: the running aggregate over rows of the same
    ``keys`` in ``order`` (must be a total order within a key)."""
    ranged = with_buckets(df, keys, order, buckets, scan).drop(_AT)

    # 1. one summary row per (bucket, key): partial aggregates
    summary = ranged.groupBy(_B, *keys).agg(*[_AGG[s.func](_value(s)).alias(s.out) for s in specs])
    # 2. carry-in: combine the summaries of earlier buckets of the same key;
    #    at most one row per bucket survives the filter
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *_group_columns(keys),
        F.count(F.lit(1)).over(before).alias("__earlier"),
        *[_AGG[_COMBINE[s.func]](F.col(s.out)).over(before).alias(f"__carry_{s.out}") for s in specs],
    ).where(F.col("__earlier") > 0).drop("__earlier")

    # 3. local running values inside (bucket, key)
    local = Window.partitionBy(_B, *keys).orderBy(*_sorted_by(order))
    out = ranged
    for s in specs:
        hi = Window.currentRow if s.inclusive else -1
        w = local.rowsBetween(Window.unboundedPreceding, hi)
        out = out.withColumn(f"__local_{s.out}", _AGG[s.func](_value(s)).over(w))
    out = _without_group(out.join(F.broadcast(carry), on=_same_group(keys), how="left"), keys)
    for s in specs:
        loc, car = F.col(f"__local_{s.out}"), F.col(f"__carry_{s.out}")
        if s.func in ("count", "sum"):
            val = F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))
            if s.func == "sum":
                val = F.when(loc.isNull() & car.isNull(), F.lit(None)).otherwise(val)
        elif s.func == "min":
            val = F.least(loc, car)
        else:
            val = F.greatest(loc, car)
        out = out.withColumn(s.out, val).drop(f"__local_{s.out}", f"__carry_{s.out}")
    return out.drop(_B)


def row_positions(
    df: DataFrame, keys: list[str], order: list, out: str = "pos", base: int = 0, scan: bool = False
) -> DataFrame:
    """``row_number() over (partition by keys order by order) - 1 + base``
    computed skew-safely; ``keys=[]`` gives a global dense position."""
    ranged = with_buckets(df, keys, order, scan=scan)
    groups = ranged.groupBy(_B, *keys).agg(F.count(F.lit(1)).alias("__n"), F.min(_AT).alias("__first"))
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("__n").over(before), F.lit(0))
    offsets = groups.select(*_group_columns(keys), (earlier - F.col("__first") + F.lit(base)).alias("__offset"))
    if not keys:
        # a row per bucket: the last one's number says how many
        last = ranged.agg(F.max(_B)).first()[0] or 0
        offsets = F.broadcast(offsets) if last < BROADCAST_BUCKETS else offsets
    placed = ranged.join(offsets, on=_same_group(keys), how="inner")
    return _without_group(placed.withColumn(out, (F.col(_AT) + F.col("__offset")).cast("long")), keys).drop(_B, _AT, "__offset")
