"""Queries: ordering, histograms, coverage, stage counts (SRT1-4, AGG1-4,
AGG8, ARR3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import measure as me
from ..operators.positions import desc
from . import fixtures as fx
from .q_text import COUNTED_SQL, counted_p
from .registry import cte, query, sql_clean, sql_ratio, sql_wc

def ratio_desc():
    return [desc("ratio"), "row_id"]

SIDES = {"src": "src_words", "tgt": "tgt_words"}


@query(
    "ratio_sorted",
    cte(c=COUNTED_SQL)
    + "SELECT row_id, ratio, row_number() OVER (ORDER BY ratio DESC, row_id) - 1 AS pos FROM c",
)
def q_ratio_sorted(spark, d):
    return me.positions_by(counted_p(spark, d), ratio_desc()).select("row_id", "ratio", "pos")


@query(
    "offset_rows",
    cte(c=COUNTED_SQL) + "SELECT row_id, ratio FROM c ORDER BY ratio DESC, row_id OFFSET 1000",
)
def q_offset_rows(spark, d):
    return me.skip_rows(counted_p(spark, d), 1000, ratio_desc()).select("row_id", "ratio")


@query(
    "tail_rows",
    cte(c=COUNTED_SQL) + "SELECT row_id, ratio FROM c ORDER BY ratio ASC, row_id DESC LIMIT 5",
)
def q_tail_rows(spark, d):
    return me.top_k(counted_p(spark, d), 5, [F.col("ratio").asc(), F.col("row_id").desc()]).select(
        "row_id", "ratio"
    )


@query(
    "topk_ratio",
    cte(c=COUNTED_SQL)
    + "SELECT row_id, src_words, tgt_words, ratio FROM c ORDER BY ratio DESC, row_id LIMIT 20",
)
def q_topk_ratio(spark, d):
    return me.top_k(counted_p(spark, d), 20, [F.col("ratio").desc(), F.col("row_id")]).select("row_id", "src_words", "tgt_words", "ratio")


def _hist_sql(bins: int, limit: int) -> str:
    return cte(c=COUNTED_SQL) + f"""
, v AS (SELECT 'src' AS side, src_words AS len FROM c UNION ALL SELECT 'tgt', tgt_words FROM c),
cnt AS (SELECT side, CAST(least(floor(len * {bins} / {limit}), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
        FROM v WHERE len BETWEEN 0 AND {limit} GROUP BY 1, 2),
spine AS (SELECT s.side, CAST(b.bin AS INTEGER) AS bin FROM (VALUES ('src'), ('tgt')) s(side), range({bins}) b(bin))
SELECT spine.side, spine.bin, spine.bin * {float(limit)} / {bins} AS lo, (spine.bin + 1) * {float(limit)} / {bins} AS hi,
       CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM spine LEFT JOIN cnt ON spine.side = cnt.side AND spine.bin = cnt.bin
"""


@query("length_hist_100", _hist_sql(80, 100))
def q_length_hist_100(spark, d):
    return me.length_histogram(counted_p(spark, d), SIDES, 80, 100)


@query("length_hist_40", _hist_sql(80, 40))
def q_length_hist_40(spark, d):
    return me.length_histogram(counted_p(spark, d), SIDES, 80, 40)


@query(
    "length_hist_auto",
    cte(c=COUNTED_SQL)
    + """
, v AS (SELECT 'src' AS side, src_words AS len FROM c UNION ALL SELECT 'tgt', tgt_words FROM c),
r AS (SELECT side, min(len) AS lo_all, max(len) AS hi_all FROM v GROUP BY side),
cnt AS (SELECT v.side, CAST(CASE WHEN hi_all = lo_all THEN 15
                    ELSE least(floor((len - lo_all) * 30 / (hi_all - lo_all)), 29) END AS INTEGER) AS bin,
               count(*) AS n
        FROM v JOIN r ON v.side = r.side GROUP BY 1, 2),
spine AS (SELECT r.side, CAST(b.bin AS INTEGER) AS bin, lo_all, hi_all FROM r, range(30) b(bin))
SELECT spine.side, spine.bin,
       CAST(lo_all + spine.bin * (hi_all - lo_all) / 30 AS DOUBLE) AS lo,
       CAST(lo_all + (spine.bin + 1) * (hi_all - lo_all) / 30 AS DOUBLE) AS hi,
       CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM spine LEFT JOIN cnt ON spine.side = cnt.side AND spine.bin = cnt.bin
""",
)
def q_length_hist_auto(spark, d):
    return me.length_histogram_auto(counted_p(spark, d), SIDES, 30)


@query(
    "length_coverage",
    cte(c=COUNTED_SQL)
    + """
, v AS (SELECT 'src' AS side, src_words AS len FROM c UNION ALL SELECT 'tgt', tgt_words FROM c)
SELECT side, count(*) AS n, count(*) FILTER (WHERE len < 30) AS n_under,
       round(avg(CASE WHEN len < 30 THEN 1.0 ELSE 0.0 END), 6) AS share_under, CAST(max(len) AS BIGINT) AS max_len
FROM v GROUP BY side
""",
)
def q_length_coverage(spark, d):
    return me.length_coverage(counted_p(spark, d), SIDES, 30)


QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


@query(
    "length_quantiles",
    cte(c=COUNTED_SQL)
    + """
, v AS (SELECT 'src' AS side, src_words AS len FROM c UNION ALL SELECT 'tgt', tgt_words FROM c),
l AS (SELECT side, count(*) AS n, list_sort(list(len)) AS lens FROM v GROUP BY side)
SELECT side, n, """
    + ", ".join(
        f"CAST(lens[CAST(greatest(ceil(CAST({q} AS DOUBLE) * n), 1) AS BIGINT)] AS BIGINT) AS {name}"
        for name, q in QUANTILES.items()
    )
    + " FROM l",
)
def q_length_quantiles(spark, d):
    return me.length_quantiles(counted_p(spark, d), SIDES, QUANTILES)


@query(
    "max_length",
    cte(c=COUNTED_SQL)
    + """
SELECT corpus, max(src_words) AS max_src, max(tgt_words) AS max_tgt, max(greatest(src_words, tgt_words)) AS max_len
FROM c GROUP BY corpus
""",
)
def q_max_length(spark, d):
    return counted_p(spark, d).groupBy("corpus").agg(
        F.max("src_words").alias("max_src"),
        F.max("tgt_words").alias("max_tgt"),
        me.max_length(["src_words", "tgt_words"]).alias("max_len"),
    )


@query(
    "stage_counts",
    cte(h=fx.HOLEY_SQL)
    + f"""
, f AS (SELECT corpus,
        (src IS NOT NULL AND src <> '' AND tgt IS NOT NULL AND tgt <> '') AS ok,
        {sql_clean('src')} AS cs, {sql_clean('tgt')} AS ct FROM h)
SELECT corpus, count(*) AS n_raw,
       count(*) FILTER (WHERE ok) AS n_valid,
       count(*) FILTER (WHERE ok AND cs <> '' AND ct <> '') AS n_clean,
       count(*) FILTER (WHERE ok AND cs <> '' AND ct <> ''
                        AND {sql_ratio(sql_wc('ct'), sql_wc('cs'))} BETWEEN 0.75 AND 1.25) AS n_band
FROM f GROUP BY corpus
""",
)
def q_stage_counts(spark, d):
    h = fx.holey_lines(spark, d)
    ok = F.col("src").isNotNull() & (F.col("src") != "") & F.col("tgt").isNotNull() & (F.col("tgt") != "")
    f = h.select("corpus", ok.alias("ok"), tx.clean_text("src").alias("cs"), tx.clean_text("tgt").alias("ct"))
    clean_ok = F.col("ok") & (F.col("cs") != "") & (F.col("ct") != "")
    band = tx.word_ratio(tx.word_count("ct"), tx.word_count("cs")).between(0.75, 1.25)
    return f.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(F.col("ok")).alias("n_valid"),
        F.count_if(clean_ok).alias("n_clean"),
        F.count_if(clean_ok & band).alias("n_band"),
    )

