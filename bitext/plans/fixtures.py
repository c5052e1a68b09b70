"""Inputs of the registered queries, derived from the driver's tables.

Each fixture exists twice: as a Spark plan (``*_df``) and as a DuckDB CTE
body (``*_SQL``) for the oracle.  Both must stay expression-for-expression
equal; the oracle never sees the Spark code.

P  parallel lines: one row per line of ``documents.text``
C  conversation pairs: a user turn and the assistant turn that follows it
H  training history: per ``events.user_id`` (run), events in time order
S  scored steps: four candidate tokens per decoding step, from ``events``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import row_positions
from ..sources.lines import FUNCTION_WORDS, LINE_ID_STRIDE
from ..sources.tables import spread, table

# Fixed values of the fixtures.
PRO_EVERY = 5                    # doc_id % 5 = 0 -> corpus 'pro'
CANDIDATES_PER_STEP = 4
END_TOKEN = 7
LOSS_FACTOR = 0.9


# ---------------------------------------------------------------- P
def parallel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, corpus, lang, src, tgt."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    lines = docs.select(
        "doc_id", "lang", F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "tgt")
    )
    return lines.select(
        (F.col("doc_id") * LINE_ID_STRIDE + F.col("line_no")).alias("row_id"),
        F.when(F.col("doc_id") % PRO_EVERY == 0, F.lit("pro")).otherwise(F.lit("ai")).alias("corpus"),
        "lang",
        F.regexp_replace("tgt", FUNCTION_WORDS, "$1").alias("src"),
        "tgt",
    )


P_SQL = f"""
SELECT doc_id * {LINE_ID_STRIDE} + line_no AS row_id,
       CASE WHEN doc_id % {PRO_EVERY} = 0 THEN 'pro' ELSE 'ai' END AS corpus,
       lang,
       regexp_replace(tgt, '{FUNCTION_WORDS}', '\\1', 'g') AS src,
       tgt
FROM (SELECT doc_id, lang,
             unnest(string_split(text, chr(10))) AS tgt,
             unnest(range(len(string_split(text, chr(10))))) AS line_no
      FROM documents)
"""


def noisy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P with pause marks and comma runs appended to ``src`` (for STR1/STR2)."""
    p = parallel_lines(spark, sf_dir)
    noisy = F.concat(
        F.col("src"), F.lit(" (pause "), (F.col("row_id") % 10).cast("string"), F.lit("."),
        (F.col("row_id") % 100).cast("string"), F.lit(") , , ,"),
    )
    return p.withColumn("src", noisy)


NOISY_SQL = f"""
SELECT row_id, corpus, lang,
       src || ' (pause ' || CAST(row_id % 10 AS VARCHAR) || '.' || CAST(row_id % 100 AS VARCHAR) || ') , , ,' AS src,
       tgt
FROM ({P_SQL})
"""


def holey_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P with null and empty sources mixed in (for FLT1/FLT2)."""
    p = parallel_lines(spark, sf_dir)
    src = (
        F.when(F.col("row_id") % 7 == 0, F.lit(None).cast("string"))
        .when(F.col("row_id") % 11 == 0, F.lit(""))
        .otherwise(F.col("src"))
    )
    return p.withColumn("src", src)


HOLEY_SQL = f"""
SELECT row_id, corpus, lang,
       CASE WHEN row_id % 7 = 0 THEN NULL WHEN row_id % 11 = 0 THEN '' ELSE src END AS src,
       tgt
FROM ({P_SQL})
"""


# ---------------------------------------------------------------- C
def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, src (user turn), tgt (the assistant turn right after it).

    An equi-join on (conv_id, turn) rather than ``lead`` over a conversation
    window: a very long conversation is then spread over many tasks."""
    conv = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id")
    user = conv.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("src"),
        F.col("turn").alias("user_turn"),
    )
    asst = conv.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("tgt"))
    return user.join(asst, ["conv_id", "turn"]).select(
        (F.col("conv_id") * LINE_ID_STRIDE + F.col("user_turn")).alias("row_id"), "src", "tgt"
    )


C_SQL = f"""
SELECT u.conv_id * {LINE_ID_STRIDE} + u.turn AS row_id, u.text AS src, a.text AS tgt
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""


# ---------------------------------------------------------------- H
def _event_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", "props")
    return row_positions(ev, ["user_id"], ["ts", "event_id"], out="rn", base=0, scan=True)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, epoch (1-based), loss, val_loss."""
    ev = _event_positions(spark, sf_dir)
    return ev.select(
        F.col("user_id").alias("run_id"),
        (F.col("rn") + 1).cast("int").alias("epoch"),
        (F.col("value") * LOSS_FACTOR).alias("loss"),
        F.col("value").alias("val_loss"),
    )


H_SQL = f"""
SELECT user_id AS run_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS epoch,
       value * {LOSS_FACTOR} AS loss, value AS val_loss
FROM events
"""


# ---------------------------------------------------------------- S
def scored_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, step, token_id, score, cand (candidate number in the step)."""
    ev = _event_positions(spark, sf_dir)
    return ev.select(
        F.col("user_id").alias("pair_id"),
        F.floor(F.col("rn") / CANDIDATES_PER_STEP).cast("int").alias("step"),
        F.get_json_object("props", "$.k").cast("int").alias("token_id"),
        F.col("value").alias("score"),
        (F.col("rn") % CANDIDATES_PER_STEP).cast("int").alias("cand"),
    )


S_SQL = f"""
SELECT user_id AS pair_id,
       CAST((row_number() OVER w - 1) // {CANDIDATES_PER_STEP} AS INTEGER) AS step,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS token_id,
       value AS score,
       CAST((row_number() OVER w - 1) % {CANDIDATES_PER_STEP} AS INTEGER) AS cand
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""


def step_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, step, real_id, p: the label of a step is the first
    candidate's token (0 = pad when divisible by 5), ``p`` the model's
    probability of it."""
    s = scored_steps(spark, sf_dir).where(F.col("cand") == 0)
    return s.select(
        "pair_id", "step",
        F.when(F.col("token_id") % 5 == 0, F.lit(0)).otherwise(F.col("token_id")).alias("real_id"),
        ((F.lit(1.0) + F.col("score")) / F.lit(1000.0)).alias("p"),
    )


LABELS_SQL = f"""
SELECT pair_id, step,
       CASE WHEN token_id % 5 = 0 THEN 0 ELSE token_id END AS real_id,
       (1.0 + score) / 1000.0 AS p
FROM ({S_SQL}) WHERE cand = 0
"""
