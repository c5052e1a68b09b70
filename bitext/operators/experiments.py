"""Experiment tables (EXP1-6, WIN1-3, STR18, JOI3).

A history is ``(run_id, epoch, loss, val_loss)``, one row per run and epoch.
Early stopping needs the best value so far and the epoch of the last
improvement, over a run's epochs in order.  Epochs are numbers, so a run is cut
into segments of ``SEGMENT`` epochs: one grouping by (run, segment) gathers each
segment's rows in order (bounded), and the history is read once.  What a segment
does to the state is combinable: its minimum and the epoch of it.  A prefix over
the segments' minima (a few numbers each) gives every segment the state that it
starts with, and a fold over the segment's rows yields its first stop per
patience and its last state.  Per run the first stop and the last state remain:
partial aggregates.  So a run with a huge history is spread over many tasks.

The parameter grid is the product of value lists, given or found in results,
generated by ``spark.range`` and mixed-radix indexing: no join, no single
task, any size.  Its order is the product order (last dimension fastest).
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import written

SEGMENT = 4096  # epochs gathered in one row

# The search dimensions and their value lists.
GRID_DIMS = {
    "patience": [3, 5],
    "units": [128, 256],
    "learning_rate": [0.001, 0.0001, 0.01],
    "dropout": [0.3, 0.5, 0.7],
    "embedding_dim": [128, 256],
    "activation": ["relu", "tanh"],
    "regularizer": [None, "l2"],
}


def assign_params(runs: DataFrame, run_col: str = "run_id", dims: dict = GRID_DIMS) -> DataFrame:
    """Give each run one grid point: mixed-radix digits of ``run_id``
    (first dimension varies fastest)."""
    out, stride = runs, 1
    for name, values in dims.items():
        digit = (F.col(run_col) / F.lit(stride)).cast("long") % len(values)
        arr = F.array(*[F.lit(v) for v in values])
        out = out.withColumn(name, F.element_at(arr, (digit + 1).cast("int")))
        stride *= len(values)
    return out


def value_text(col: Column, is_float: bool) -> Column:
    """Plain decimal text of a value (``0.0001``, not ``1.0E-4``): up to 10
    decimals, trailing zeros dropped, at least one decimal for floats."""
    if not is_float:
        return col.cast("string")
    t = F.regexp_replace(F.format_string("%.10f", col), "0+$", "")
    return F.when(F.endswith(t, F.lit(".")), F.concat(t, F.lit("0"))).otherwise(t)


def experiment_key(dims=tuple(GRID_DIMS)) -> Column:
    """STR18: ``name=value`` pairs joined by ``_`` (null -> 'None')."""
    parts = []
    for d in dims:
        is_float = any(isinstance(v, float) for v in GRID_DIMS.get(d, []))
        parts.append(F.concat(F.lit(f"{d}="), F.coalesce(value_text(F.col(d), is_float), F.lit("None"))))
    return F.concat_ws("_", *parts)


def grid_from_values(spark: SparkSession, values: dict[str, list], types: dict[str, str] | None = None) -> DataFrame:
    """EXP1/JOI3: the product of value lists, before any result exists: grid_idx
    (0-based, in product order), the dimensions and the key.  None is a value."""
    total = prod(len(v) for v in values.values())
    grid, stride = spark.range(total).withColumnRenamed("id", "grid_idx"), total
    for name, items in values.items():
        stride //= max(1, len(items))
        digit = F.expr(f"grid_idx div {max(1, stride)}") % max(1, len(items))
        value = F.element_at(F.array(*[F.lit(v) for v in items]), (digit + 1).cast("int"))
        grid = grid.withColumn(name, value.cast(types[name]) if types else value)
    return grid.withColumn("key", experiment_key(tuple(values)))


def dimension_values(results: DataFrame, dims=tuple(GRID_DIMS)) -> dict[str, list]:
    """The distinct values per dimension, sorted, nulls last; as many rows reach
    the driver as the dimensions have values."""
    seen = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("v")) for d in dims]))
    rows = results.select(seen.alias("x")).select("x.*").distinct().collect()
    return {d: sorted((r["v"] for r in rows if r["dim"] == d), key=lambda v: (v is None, v or "")) for d in dims}


def param_grid(results: DataFrame, dims=tuple(GRID_DIMS)) -> DataFrame:
    """EXP1/JOI3: product of the distinct values seen per dimension, with a
    grid index and key.  Nulls are values too (``regularizer``)."""
    return grid_from_values(results.sparkSession, dimension_values(results, dims), dict(results.select(*dims).dtypes))


def early_stop(history: DataFrame, patiences=(3,)) -> DataFrame:
    """WIN1: per run, the first epoch at which val_loss has not improved for
    ``patience`` epochs (a tie is not an improvement); null = ran to the end.
    Columns: run_id, last_epoch, stop_p{patience}..."""
    stops = run_stops(history, patiences)
    return stops.select("run_id", F.col("end.epoch").alias("last_epoch"), *[F.col(f"at_p{p}.epoch").alias(f"stop_p{p}") for p in patiences])


def run_stops(history: DataFrame, patiences=(3,)) -> DataFrame:
    """run_id, at_p{patience} (the state at the first stop, null if there is none)
    and end (at the last epoch).  A state has epoch, loss, val_loss, best_epoch and
    best_val_loss: the last improvement up to there, which is the earliest of the
    lowest values.  An epoch without val_loss is no improvement."""
    segments = written(
        history.groupBy("run_id", F.floor(F.col("epoch") / SEGMENT).alias("segment")).agg(
            F.sort_array(F.collect_list(F.struct("epoch", "val_loss", "loss"))).alias("rows"),
            F.min("val_loss").alias("low"),
            F.min_by("epoch", F.when(F.col("val_loss").isNotNull(), F.struct("val_loss", "epoch"))).alias("low_at"),
        ),
        "segments",
    )
    # the state that a segment starts with, from the minima of the segments before it
    before = Window.partitionBy("run_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(F.when(F.col("low").isNotNull(), F.struct("low", "low_at"))).over(before)
    carry = segments.select("run_id", "segment", best.alias("before"))
    rows = segments.select("run_id", "segment", "rows").join(carry, ["run_id", "segment"])

    kinds = dict(history.dtypes)
    state = "epoch {epoch}, loss {loss}, val_loss {val_loss}, best_epoch {epoch}, best_val_loss {val_loss}".format(**kinds)
    none = F.lit(None).cast(f"struct<{state.replace(', ', ',').replace(' ', ':')}>")
    names = [f"at_p{p}" for p in patiences]

    def step(acc: Column, row: Column) -> Column:
        old = acc["end"]
        better = row["val_loss"].isNotNull() & (old["best_val_loss"].isNull() | (row["val_loss"] < old["best_val_loss"]))
        now = F.struct(
            row["epoch"].alias("epoch"), row["loss"].alias("loss"), row["val_loss"].alias("val_loss"),
            F.when(better, row["epoch"]).otherwise(old["best_epoch"]).alias("best_epoch"),
            F.when(better, row["val_loss"]).otherwise(old["best_val_loss"]).alias("best_val_loss"),
        )
        gap = row["epoch"] - F.when(better, row["epoch"]).otherwise(old["best_epoch"])
        stops = [F.when(acc[n].isNull() & (gap >= p), now).otherwise(acc[n]).alias(n) for n, p in zip(names, patiences)]
        return F.struct(*stops, now.alias("end"))

    start = F.struct(
        *[none.alias(n) for n in names],
        F.struct(
            F.lit(None).cast(kinds["epoch"]).alias("epoch"), F.lit(None).cast(kinds["loss"]).alias("loss"),
            F.lit(None).cast(kinds["val_loss"]).alias("val_loss"), F.col("before.low_at").alias("best_epoch"),
            F.col("before.low").alias("best_val_loss"),
        ).alias("end"),
    )
    folded = rows.select("run_id", F.aggregate("rows", start, step).alias("s")).select("run_id", "s.*")
    first = [F.min_by(n, F.col(f"{n}.epoch")).alias(n) for n in names]
    return folded.groupBy("run_id").agg(*first, F.max_by("end", F.col("end.epoch")).alias("end"))


def best_epoch(history: DataFrame, stops: DataFrame | None = None, stop_col: str | None = None) -> DataFrame:
    """WIN2: epoch of the lowest val_loss (earliest on ties), within the
    epochs run (up to the stop epoch when ``stops`` is given)."""
    h = history
    if stops is not None:
        h = h.join(stops.select("run_id", stop_col), "run_id", "left").where(
            F.col(stop_col).isNull() | (F.col("epoch") <= F.col(stop_col))
        )
    order = F.struct(F.col("val_loss"), F.col("epoch"))
    return h.groupBy("run_id").agg(
        F.min_by(F.col("epoch"), order).alias("best_epoch"),
        F.min("val_loss").alias("best_val_loss"),
    )


def final_epoch(history: DataFrame) -> DataFrame:
    """WIN3: epochs run and the losses of the last epoch."""
    return history.groupBy("run_id").agg(
        F.max("epoch").alias("epochs"),
        F.max_by("loss", "epoch").alias("final_train_loss"),
        F.max_by("val_loss", "epoch").alias("final_val_loss"),
    )


def loss_curve_long(history: DataFrame) -> DataFrame:
    """EXP5: one row per (run, epoch, series)."""
    return history.unpivot(["run_id", "epoch"], ["loss", "val_loss"], "series", "value")
