"""Queries over scored decoding steps (ARR8, WIN5, UDF4, EVA9-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import metrics as mt
from ..operators import vocab as vb
from . import fixtures as fx
from .q_vocab import MAX_TOKENS, TOK_SQL, vocab, vocab_sql
from .registry import cte, query

MAX_DECODE = 40          # decode cap of the transformer's translate loop

ARGMAX_SQL = """
SELECT pair_id, step, token_id FROM (
  SELECT pair_id, step, token_id,
         row_number() OVER (PARTITION BY pair_id, step ORDER BY score DESC, token_id) AS rn
  FROM s) WHERE rn = 1
"""


@query("argmax_token", cte(s=fx.S_SQL, best=ARGMAX_SQL) + "SELECT * FROM best")
def q_argmax_token(spark, d):
    return mt.argmax_token(fx.scored_steps(spark, d))


@query(
    "greedy_decode",
    cte(s=fx.S_SQL, best=ARGMAX_SQL, tok=TOK_SQL)
    + f""", voc AS ({vocab_sql(MAX_TOKENS)}),
seq AS (SELECT pair_id, list(token_id ORDER BY step) AS ids FROM best WHERE step < {MAX_DECODE} GROUP BY pair_id),
cut AS (SELECT pair_id, CASE WHEN list_position(ids, {fx.END_TOKEN}) IS NOT NULL
                             THEN ids[1:list_position(ids, {fx.END_TOKEN}) - 1] ELSE ids END AS ids FROM seq),
words AS (SELECT c.pair_id, coalesce(string_agg(v.token, ' ' ORDER BY u.pos)
                   FILTER (WHERE v.token IS NOT NULL AND u.id NOT IN (0, 1)), '') AS text
          FROM cut c
          LEFT JOIN (SELECT pair_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM cut) u ON c.pair_id = u.pair_id
          LEFT JOIN voc v ON u.id = v.id
          GROUP BY c.pair_id)
SELECT cut.pair_id, array_to_string(ids, ' ') AS ids, CAST(len(ids) AS BIGINT) AS n_tokens, words.text
FROM cut JOIN words ON cut.pair_id = words.pair_id
""",
)
def q_greedy_decode(spark, d):
    dec = mt.greedy_decode(fx.scored_steps(spark, d), fx.END_TOKEN, MAX_DECODE)
    words = vb.decode(dec, ["pair_id"], "ids", vocab(spark, d), skip_ids=(0, 1), max_tokens=MAX_TOKENS)
    return dec.join(words, "pair_id").select(
        "pair_id", tx.array_to_text("ids").alias("ids"), "n_tokens", "text"
    )


METRIC_SQL = cte(s=fx.S_SQL, best=ARGMAX_SQL, lab=fx.LABELS_SQL) + """
, j AS (SELECT lab.real_id, lab.p, best.token_id AS pred_id
        FROM lab LEFT JOIN best ON lab.pair_id = best.pair_id AND lab.step = best.step),
agg AS (SELECT count(*) AS n_tokens,
               sum(CASE WHEN real_id <> 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS n_mask,
               sum(CASE WHEN real_id <> 0 AND real_id = pred_id THEN 1.0 ELSE 0.0 END)::DOUBLE AS n_hit,
               sum(-ln(p) * CASE WHEN real_id <> 0 THEN 1.0 ELSE 0.0 END) AS nll
        FROM j)
"""


def _metrics(spark, d):
    preds = mt.argmax_token(fx.scored_steps(spark, d))
    return mt.masked_metrics(fx.step_labels(spark, d), preds)


@query(
    "masked_accuracy",
    METRIC_SQL + "SELECT n_tokens, CAST(n_mask AS BIGINT) AS n_real, round(n_hit / n_mask, 6) AS accuracy FROM agg",
)
def q_masked_accuracy(spark, d):
    return _metrics(spark, d).select("n_tokens", "n_real", "accuracy")


@query("masked_loss", METRIC_SQL + "SELECT CAST(n_mask AS BIGINT) AS n_real, round(nll / n_mask, 6) AS loss FROM agg")
def q_masked_loss(spark, d):
    return _metrics(spark, d).select("n_real", "loss")


# scores spread over about -1000 to 1200, as unscaled logits may be
LOGIT_SHIFT, LOGIT_SCALE = 250.0, 4.0


@query(
    "masked_loss_logits",
    cte(s=fx.S_SQL, lab=fx.LABELS_SQL)
    + f"""
, l AS (SELECT s.pair_id, s.step, s.token_id, lab.real_id, (score - CAST({LOGIT_SHIFT} AS DOUBLE)) * CAST({LOGIT_SCALE} AS DOUBLE) AS x
        FROM s JOIN lab ON s.pair_id = lab.pair_id AND s.step = lab.step),
m AS (SELECT *, max(x) OVER (PARTITION BY pair_id, step) AS top FROM l),
t AS (SELECT pair_id, step, any_value(real_id) AS real_id,
             any_value(top) + ln(sum(exp(x - top))) - max(CASE WHEN token_id = real_id THEN x END) AS loss
      FROM m GROUP BY pair_id, step)
SELECT count(*) AS n_tokens, count(*) FILTER (WHERE real_id <> 0) AS n_real,
       round(sum(CASE WHEN real_id <> 0 THEN loss ELSE 0 END) / count(*) FILTER (WHERE real_id <> 0), 6) AS loss,
       round(sum(CASE WHEN real_id <> 0 THEN loss ELSE 0 END) / count(*), 6) AS loss_all
FROM t
""",
)
def q_masked_loss_logits(spark, d):
    steps = fx.scored_steps(spark, d).withColumn("score", (F.col("score") - LOGIT_SHIFT) * LOGIT_SCALE)
    return mt.masked_loss(mt.step_loss(fx.step_labels(spark, d), steps))


@query("masked_loss_all", METRIC_SQL + "SELECT n_tokens, round(nll / n_tokens, 6) AS loss_all FROM agg")
def q_masked_loss_all(spark, d):
    return _metrics(spark, d).select("n_tokens", "loss_all")

