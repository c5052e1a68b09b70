"""Queries: training histories and experiment tables (WIN1-3, EXP1-6,
STR18, JOI3).

Runs are the ``events`` users (fixture H); each run gets one point of the
reference's search grid from the digits of its id, and a score from a
hash of its key, so every table below grows with the events table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import stable_hash
from ..operators import experiments as ex
from ..scratch import written
from . import fixtures as fx
from .registry import cte, query

PATIENCES = (3, 5, 8, 10, 1000)
DIMS = tuple(ex.GRID_DIMS)
FLOAT_DIMS = {d for d, vs in ex.GRID_DIMS.items() if any(isinstance(v, float) for v in vs)}


# ---- DuckDB side ---------------------------------------------------------------

def _sql_list(values) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return f"'{v}'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)

    return "[" + ", ".join(lit(v) for v in values) + "]"


def _sql_params() -> str:
    cols, stride = [], 1
    for name, values in ex.GRID_DIMS.items():
        cols.append(f"{_sql_list(values)}[(run_id // {stride}) % {len(values)} + 1] AS {name}")
        stride *= len(values)
    return "SELECT run_id, " + ", ".join(cols) + " FROM (SELECT DISTINCT run_id FROM h)"


def _sql_text(d: str) -> str:
    if d in FLOAT_DIMS:
        t = f"regexp_replace(printf('%.10f', {d}), '0+$', '')"
        return f"CASE WHEN suffix({t}, '.') THEN {t} || '0' ELSE {t} END"
    return f"CAST({d} AS VARCHAR)"


def _sql_key() -> str:
    return " || '_' || ".join(f"'{d}=' || coalesce({_sql_text(d)}, 'None')" for d in DIMS)


EARLY_SQL = """
, a AS (SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_min FROM h),
b AS (SELECT *, max(CASE WHEN prior_min IS NULL OR val_loss < prior_min THEN epoch END)
                OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp
      FROM a),
es AS (SELECT run_id, max(epoch) AS last_epoch, """ + ", ".join(
    f"min(CASE WHEN epoch - last_imp >= {p} THEN epoch END) AS stop_p{p}" for p in PATIENCES
) + " FROM b GROUP BY run_id)\n"

RESULTS_SQL = cte(h=fx.H_SQL) + EARLY_SQL + f"""
, par AS ({_sql_params()}),
pk AS (SELECT *, {_sql_key()} AS key FROM par),
r0 AS (SELECT pk.*, coalesce(CASE WHEN patience = 3 THEN stop_p3 ELSE stop_p5 END, last_epoch) AS epochs
       FROM pk JOIN es ON pk.run_id = es.run_id),
hh AS (SELECT h.*, r0.epochs FROM h JOIN r0 ON h.run_id = r0.run_id WHERE h.epoch <= r0.epochs),
agg AS (SELECT run_id, arg_min(epoch, (val_loss, epoch)) AS best_epoch, min(val_loss) AS best_val_loss,
               arg_max(loss, epoch) AS final_train_loss, arg_max(val_loss, epoch) AS final_val_loss
        FROM hh GROUP BY run_id),
res AS (SELECT r0.*, agg.best_epoch, agg.best_val_loss, agg.final_train_loss, agg.final_val_loss,
               round(CAST(CAST('0x' || substr(md5('bleu' || ':' || key || ':' || CAST(r0.run_id AS VARCHAR)), 1, 8) AS BIGINT)
                          AS DOUBLE) / CAST(4294967296.0 AS DOUBLE), 6) AS bleu
        FROM r0 JOIN agg ON r0.run_id = agg.run_id)
"""


# ---- Spark side ------------------------------------------------------------------

def results(spark, d):
    """One row per run: its grid point, key, early-stop epochs, best and
    final losses, and score."""
    runs = ex.assign_params(ex.run_stops(fx.history(spark, d), (3, 5))).withColumn("key", ex.experiment_key(DIMS))
    last = F.coalesce(F.when(F.col("patience") == 3, F.col("at_p3")).otherwise(F.col("at_p5")), F.col("end"))
    score = F.round(stable_hash("bleu", "key", "run_id") / F.lit(4294967296.0), 6)
    out = runs.withColumn("last", last).select(
        "run_id", *DIMS, "key", F.col("last.epoch").alias("epochs"),
        F.col("last.best_epoch").alias("best_epoch"), F.col("last.best_val_loss").alias("best_val_loss"),
        F.col("last.loss").alias("final_train_loss"), F.col("last.val_loss").alias("final_val_loss"), score.alias("bleu"),
    )
    return written(out, "results")  # one row per run; queries read it more than once


@query(
    "early_stop",
    cte(h=fx.H_SQL) + EARLY_SQL + f"SELECT run_id, last_epoch, {', '.join(f'stop_p{p}' for p in PATIENCES)} FROM es",
)
def q_early_stop(spark, d):
    return ex.early_stop(fx.history(spark, d), PATIENCES)


@query(
    "best_epoch",
    cte(h=fx.H_SQL) + EARLY_SQL
    + """SELECT h.run_id, arg_min(epoch, (val_loss, epoch)) AS best_epoch, min(val_loss) AS best_val_loss
FROM h JOIN es ON h.run_id = es.run_id WHERE es.stop_p3 IS NULL OR h.epoch <= es.stop_p3 GROUP BY h.run_id""",
)
def q_best_epoch(spark, d):
    h = fx.history(spark, d)
    return ex.best_epoch(h, ex.early_stop(h, (3,)), "stop_p3")


@query(
    "final_epoch",
    cte(h=fx.H_SQL)
    + """SELECT run_id, max(epoch) AS epochs, arg_max(loss, epoch) AS final_train_loss,
       arg_max(val_loss, epoch) AS final_val_loss FROM h GROUP BY run_id""",
)
def q_final_epoch(spark, d):
    return ex.final_epoch(fx.history(spark, d))


@query(
    "loss_curve_long",
    cte(h=fx.H_SQL)
    + "SELECT run_id, epoch, 'loss' AS series, loss AS value FROM h UNION ALL SELECT run_id, epoch, 'val_loss', val_loss FROM h",
)
def q_loss_curve_long(spark, d):
    return ex.loss_curve_long(fx.history(spark, d))


@query(
    "experiment_key",
    cte(h=fx.H_SQL) + f", par AS ({_sql_params()})\nSELECT run_id, {_sql_key()} AS key FROM par",
)
def q_experiment_key(spark, d):
    par = ex.assign_params(fx.history(spark, d).select("run_id").distinct())
    return par.select("run_id", ex.experiment_key(DIMS).alias("key"))


_GRID_SQL = ", grid AS (SELECT " + ", ".join(f"v{i}.{d}" for i, d in enumerate(DIMS)) + " FROM " + ", ".join(
    f"(SELECT DISTINCT {d} FROM res) v{i}" for i, d in enumerate(DIMS)
) + f"),\ngk AS (SELECT *, {_sql_key()} AS key FROM grid)\n"


@query("param_grid", RESULTS_SQL + _GRID_SQL + f"SELECT {', '.join(DIMS)}, key FROM gk")
def q_param_grid(spark, d):
    return ex.param_grid(results(spark, d), DIMS).select(*DIMS, "key")


@query(
    "grid_missing",
    RESULTS_SQL + _GRID_SQL + f"SELECT {', '.join(DIMS)}, key FROM gk WHERE key NOT IN (SELECT key FROM res)",
)
def q_grid_missing(spark, d):
    res = results(spark, d)
    grid = ex.param_grid(res, DIMS)
    return grid.join(res.select("key"), "key", "left_anti").select(*DIMS, "key")


@query("best_runs", RESULTS_SQL + "SELECT run_id, key, bleu FROM res ORDER BY bleu DESC, run_id LIMIT 3")
def q_best_runs(spark, d):
    return results(spark, d).orderBy(F.col("bleu").desc(), "run_id").limit(3).select("run_id", "key", "bleu")


@query(
    "grid_summary",
    RESULTS_SQL
    + """SELECT learning_rate, units, count(*) AS n_runs, round(avg(bleu), 6) AS mean_bleu,
       max(bleu) AS max_bleu, min(bleu) AS min_bleu, round(avg(final_val_loss), 6) AS mean_final_val_loss
FROM res GROUP BY learning_rate, units""",
)
def q_grid_summary(spark, d):
    return results(spark, d).groupBy("learning_rate", "units").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.round(F.avg("bleu"), 6).alias("mean_bleu"),
        F.max("bleu").alias("max_bleu"),
        F.min("bleu").alias("min_bleu"),
        F.round(F.avg("final_val_loss"), 6).alias("mean_final_val_loss"),
    )


@query(
    "experiment_results",
    RESULTS_SQL
    + """SELECT run_id, key, patience, epochs, best_epoch, best_val_loss, final_train_loss, final_val_loss, bleu
FROM res""",
)
def q_experiment_results(spark, d):
    return results(spark, d).select(
        "run_id", "key", "patience", "epochs", "best_epoch", "best_val_loss",
        "final_train_loss", "final_val_loss", "bleu",
    )
