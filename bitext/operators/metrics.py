"""Decoding and masked metrics over scored steps (ARR8, WIN5, UDF4,
EVA9-11).

A scored-step table is ``(pair_id, step, token_id, score)``: one row per
candidate token of a decoding step (the long form of a softmax tensor).
Every operator here is a partial aggregation keyed by (pair, step) or a
global sum, so no group is ever gathered whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import PAD_ID


def argmax_token(steps: DataFrame, keys=("pair_id", "step")) -> DataFrame:
    """ARR8: best token per step; ties go to the lowest token id."""
    return steps.groupBy(*keys).agg(
        F.max_by(F.col("token_id"), F.struct(F.col("score"), -F.col("token_id"))).alias("token_id")
    )


def greedy_decode(steps: DataFrame, end_id: int, max_len: int) -> DataFrame:
    """UDF4/WIN5: per pair, argmax tokens in step order, cut before the first
    end token and after ``max_len`` steps.  Output pair_id, ids, n_tokens.

    The regrouping gathers at most ``max_len`` ids per pair (the decode cap is
    the feature), so a pair with very many scored steps stays bounded."""
    best = argmax_token(steps.where(F.col("step") < max_len))
    seqs = best.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.struct("step", "token_id"))).alias("__s")
    )
    toks = F.transform("__s", lambda e: e["token_id"])
    end_at = F.array_position(toks, F.lit(end_id))
    cut = F.when(end_at > 0, F.slice(toks, F.lit(1), end_at - 1)).otherwise(toks)
    return seqs.select("pair_id", cut.alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))


#: Scores are summed up in bands of this width, scaled by the band: exp never overflows.
_BAND = 64.0


def step_loss(labels: DataFrame, steps: DataFrame, keys=("pair_id", "step")) -> DataFrame:
    """Cross-entropy from scores (logits): keys, real_id and ``loss`` =
    ln(sum(exp(score))) - score of the real token, over a step's candidates.

    The sum is kept as (band, sum of exp(score - band)) pairs, which add up in any order
    and grouping, so tasks combine them before the shuffle; a step's few bands are
    brought to the highest one at the end.  Scores of any size are safe.  Of two
    candidates with the real token's id the higher score counts; a real token that is no
    candidate has probability 0 and an infinite loss."""
    joined = steps.where(F.col("score").isNotNull()).join(labels.select(*keys, "real_id"), list(keys))
    band = F.floor(F.col("score") / _BAND)
    bands = joined.groupBy(*keys, "real_id", band.alias("band")).agg(
        F.sum(F.exp(F.col("score") - band * _BAND)).alias("scaled"),
        F.max(F.when(F.col("token_id") == F.col("real_id"), F.col("score"))).alias("real_score"),
    )
    one = bands.groupBy(*keys, "real_id").agg(
        F.max("band").alias("top"), F.collect_list(F.struct("band", "scaled")).alias("parts"), F.max("real_score").alias("real_score")
    )
    total = F.aggregate(
        "parts", F.lit(0.0), lambda acc, x: acc + x["scaled"] * F.exp((x["band"] - F.col("top")) * F.lit(_BAND))
    )
    log_sum = F.col("top") * F.lit(_BAND) + F.log(total)
    found = one.select(*keys, "real_id", (log_sum - F.coalesce("real_score", F.lit(float("-inf")))).alias("loss"))
    return labels.select(*keys, "real_id").join(found.drop("real_id"), list(keys), "left").withColumn(
        "loss", F.coalesce("loss", F.lit(float("inf")))
    )


def masked_loss(losses: DataFrame) -> DataFrame:
    """EVA10/EVA11 from ``step_loss``: n_tokens, n_real, the mean loss over real tokens
    (``loss``) and over all tokens (``loss_all``); padding counts as no loss."""
    real = F.col("real_id") != PAD_ID
    total = F.sum(F.when(real, F.col("loss")).otherwise(0.0))
    return losses.agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count_if(real).alias("n_real"),
        F.round(total / F.count_if(real), 6).alias("loss"),
        F.round(total / F.count(F.lit(1)), 6).alias("loss_all"),
    )


def masked_metrics(labels: DataFrame, preds: DataFrame, keys=("pair_id", "step")) -> DataFrame:
    """EVA9-11 in one pass.

    labels: keys + real_id + p (model probability of the real token)
    preds:  keys + token_id (argmax)
    accuracy  = sum(real != pad and real == pred) / sum(real != pad)
    loss      = sum(-ln p * mask) / sum(mask)
    loss_all  = sum(-ln p * mask) / count(*)
    """
    j = labels.join(preds.withColumnRenamed("token_id", "pred_id"), list(keys), "left")
    mask = (F.col("real_id") != PAD_ID).cast("double")
    hit = ((F.col("real_id") != PAD_ID) & (F.col("real_id") == F.col("pred_id"))).cast("double")
    nll = -F.log(F.col("p")) * mask
    return j.agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum(mask).cast("long").alias("n_real"),
        F.round(F.sum(hit) / F.sum(mask), 6).alias("accuracy"),
        F.round(F.sum(nll) / F.sum(mask), 6).alias("loss"),
        F.round(F.sum(nll) / F.count(F.lit(1)), 6).alias("loss_all"),
    )
