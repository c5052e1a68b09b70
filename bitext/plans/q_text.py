"""Queries: ingestion, cleaning steps, text functions, filters (SRC4, SRC7,
STR1-17, FLT1-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clean as cl
from ..sources.bitext_io import profile, rename_sides
from . import fixtures as fx
from .registry import WS_RUN, cte, query, sql_clean, sql_ratio, sql_wc, sql_words

P = fx.P_SQL
NOISY = fx.NOISY_SQL
HOLEY = fx.HOLEY_SQL

CLEAN_P_SQL = f"""
SELECT row_id, corpus, lang, {sql_clean('src')} AS src, {sql_clean('tgt')} AS tgt
FROM ({P}) WHERE src IS NOT NULL AND src <> '' AND tgt IS NOT NULL AND tgt <> ''
"""
CLEAN_P_SQL = f"SELECT * FROM ({CLEAN_P_SQL}) WHERE src <> '' AND tgt <> ''"

COUNTED_SQL = f"""
SELECT row_id, corpus, lang, src, tgt, {sql_wc('src')} AS src_words, {sql_wc('tgt')} AS tgt_words,
       {sql_ratio(sql_wc('tgt'), sql_wc('src'))} AS ratio
FROM ({CLEAN_P_SQL})
"""


def clean_p(spark, d):
    return cl.clean_corpus(fx.parallel_lines(spark, d))


def counted_p(spark, d):
    return cl.with_word_counts(clean_p(spark, d))


# ---------------------------------------------------------------- SRC4 / SRC7
@query("ingest_rename", cte(c=fx.C_SQL) + "SELECT row_id, src, tgt FROM c")
def q_ingest_rename(spark, d):
    c = fx.conversation_pairs(spark, d).withColumnsRenamed({"src": "Content", "tgt": "Translation"})
    return rename_sides(c, "Content", "Translation").select("row_id", "src", "tgt")


@query(
    "profile_bitext",
    cte(h=HOLEY)
    + """
SELECT n_rows, column_name, data_type, non_null FROM (
  SELECT count(*) AS n_rows, 'row_id' AS column_name, 'bigint' AS data_type, count(row_id) AS non_null FROM h
  UNION ALL SELECT count(*), 'corpus', 'string', count(corpus) FROM h
  UNION ALL SELECT count(*), 'lang', 'string', count(lang) FROM h
  UNION ALL SELECT count(*), 'src', 'string', count(src) FROM h
  UNION ALL SELECT count(*), 'tgt', 'string', count(tgt) FROM h)
""",
)
def q_profile_bitext(spark, d):
    return profile(fx.holey_lines(spark, d))


# ---------------------------------------------------------------- STR1..STR7
@query("clean_pause", cte(n=NOISY) + "SELECT row_id, regexp_replace(src, '\\(pause \\d+\\.\\d+\\)', '', 'g') AS src FROM n")
def q_clean_pause(spark, d):
    return fx.noisy_lines(spark, d).select("row_id", tx.remove_pause("src").alias("src"))


@query("clean_commas", cte(n=NOISY) + "SELECT row_id, regexp_replace(src, ',\\s*,+', ',', 'g') AS src FROM n")
def q_clean_commas(spark, d):
    return fx.noisy_lines(spark, d).select("row_id", tx.squeeze_commas("src").alias("src"))


_SQL_REPEAT = "regexp_replace(regexp_replace(regexp_replace({x}, '\\.{{2,}}', '.', 'g'), '!{{2,}}', '!', 'g'), '\\?{{2,}}', '?', 'g')"


@query(
    "clean_repeat_punct",
    cte(n=NOISY) + f"SELECT row_id, {_SQL_REPEAT.format(x='src')} AS src, {_SQL_REPEAT.format(x='tgt')} AS tgt FROM n",
)
def q_clean_repeat_punct(spark, d):
    return fx.noisy_lines(spark, d).select(
        "row_id", tx.squeeze_repeat_punct("src").alias("src"), tx.squeeze_repeat_punct("tgt").alias("tgt")
    )


@query("clean_space", cte(n=NOISY) + "SELECT row_id, trim(regexp_replace(src, '\\s+', ' ', 'g')) AS src FROM n")
def q_clean_space(spark, d):
    return fx.noisy_lines(spark, d).select("row_id", tx.collapse_space("src").alias("src"))


@query(
    "clean_punct_space",
    cte(n=NOISY)
    + "SELECT row_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(src, '\\s+', ' ', 'g')), '([.,!?])', '\\1 ', 'g'), '\\s+', ' ', 'g')) AS src FROM n",
)
def q_clean_punct_space(spark, d):
    return fx.noisy_lines(spark, d).select(
        "row_id", tx.space_after_punct(tx.collapse_space("src")).alias("src")
    )


@query("clean_rejoin", cte(n=NOISY) + f"SELECT row_id, array_to_string({sql_words('src')}, ' ') AS src FROM n")
def q_clean_rejoin(spark, d):
    return fx.noisy_lines(spark, d).select("row_id", tx.rejoin_words("src").alias("src"))


@query(
    "clean_corpus",
    cte(n=NOISY)
    + f"""
SELECT * FROM (
  SELECT row_id, corpus, {sql_clean('src')} AS src, {sql_clean('tgt')} AS tgt
  FROM n WHERE src IS NOT NULL AND src <> '' AND tgt IS NOT NULL AND tgt <> '')
WHERE src <> '' AND tgt <> ''
""",
)
def q_clean_corpus(spark, d):
    return cl.clean_corpus(fx.noisy_lines(spark, d)).select("row_id", "corpus", "src", "tgt")


# ---------------------------------------------------------------- STR8..STR17
@query("lower_pairs", cte(p=P) + "SELECT row_id, lower(src) AS src, lower(tgt) AS tgt FROM p")
def q_lower_pairs(spark, d):
    return fx.parallel_lines(spark, d).select("row_id", tx.lower("src").alias("src"), tx.lower("tgt").alias("tgt"))


@query(
    "wrap_markers",
    cte(p=P)
    + "SELECT row_id, concat_ws(' ', '<start>', src, '<end>') AS src, concat_ws(' ', '[start]', lower(tgt), '[end]') AS tgt FROM p",
)
def q_wrap_markers(spark, d):
    p = fx.parallel_lines(spark, d)
    return p.select(
        "row_id",
        tx.wrap_markers("src", tx.ANGLE_START, tx.ANGLE_END).alias("src"),
        tx.wrap_markers(tx.lower("tgt")).alias("tgt"),
    )


@query(
    "unwrap_markers",
    cte(p=P)
    + """
SELECT row_id, CASE WHEN starts_with(w, '[start] ') AND suffix(w, ' [end]') AND length(w) >= 14
                    THEN substring(w, 9, length(w) - 14) ELSE w END AS tgt
FROM (SELECT row_id, concat_ws(' ', '[start]', lower(tgt), '[end]') AS w FROM p)
""",
)
def q_unwrap_markers(spark, d):
    p = fx.parallel_lines(spark, d)
    w = p.select("row_id", tx.wrap_markers(tx.lower("tgt")).alias("w"))
    return w.select("row_id", tx.unwrap_markers("w").alias("tgt"))


@query(
    "cut_at_marker",
    cte(p=P) + "SELECT row_id, trim(split_part(lower(tgt) || ' [end] ' || src, '[end]', 1)) AS tgt FROM p",
)
def q_cut_at_marker(spark, d):
    p = fx.parallel_lines(spark, d)
    gen = F.concat(tx.lower("tgt"), F.lit(" [end] "), F.col("src"))
    return p.select("row_id", tx.cut_at_marker(gen).alias("tgt"))


@query(
    "tokenize_ws",
    cte(p=P)
    + f"SELECT row_id, array_to_string({sql_words('src')}, '|') AS src_tokens, {sql_wc('src')} AS n_src FROM p",
)
def q_tokenize_ws(spark, d):
    p = fx.parallel_lines(spark, d)
    return p.select(
        "row_id",
        F.array_join(tx.words("src"), "|").alias("src_tokens"),
        F.size(tx.words("src")).cast("long").alias("n_src"),
    )


@query("word_counts", cte(p=P) + f"SELECT row_id, {sql_wc('src')} AS src_words, {sql_wc('tgt')} AS tgt_words FROM p")
def q_word_counts(spark, d):
    p = fx.parallel_lines(spark, d)
    return p.select("row_id", tx.word_count("src").alias("src_words"), tx.word_count("tgt").alias("tgt_words"))


@query(
    "word_ratio",
    cte(p=P) + f"SELECT row_id, {sql_ratio(sql_wc('tgt'), sql_wc('src'))} AS ratio FROM p",
)
def q_word_ratio(spark, d):
    p = fx.parallel_lines(spark, d)
    return p.select("row_id", tx.word_ratio(tx.word_count("tgt"), tx.word_count("src")).alias("ratio"))


_PUNCT_SQL = tx.ASCII_PUNCT_CLASS.replace("'", "''")


@query(
    "standardize_words",
    cte(p=P)
    + f"""
SELECT row_id, array_to_string(list_filter(list_transform(
         regexp_extract_all(lower(concat_ws(' ', '[start]', tgt, '[end]')), '{WS_RUN}'),
         lambda t: CASE WHEN t IN ('[start]', '[end]') THEN t ELSE regexp_replace(t, '{_PUNCT_SQL}', '', 'g') END),
         lambda t: t <> ''), ' ') AS tgt
FROM p
""",
)
def q_standardize_words(spark, d):
    p = fx.parallel_lines(spark, d)
    return p.select("row_id", F.array_join(tx.standardize_words(tx.wrap_markers("tgt")), " ").alias("tgt"))


@query(
    "pretokenize",
    cte(p=P)
    + "SELECT row_id, array_to_string(regexp_extract_all(lower(concat_ws(' ', '[start]', tgt, '[end]')), "
    + f"'\\[start\\]|\\[end\\]|[{tx.WORD_CLASS}]+|[^{tx.WORD_CLASS}{tx.SPACE_CLASS}]+'), ' ') AS tgt FROM p",
)
def q_pretokenize(spark, d):
    p = fx.parallel_lines(spark, d)
    return p.select("row_id", F.array_join(tx.pretokenize(tx.lower(tx.wrap_markers("tgt"))), " ").alias("tgt"))


# ---------------------------------------------------------------- FLT1..FLT5
@query("drop_null_pairs", cte(h=HOLEY) + "SELECT row_id, src, tgt FROM h WHERE src IS NOT NULL AND tgt IS NOT NULL")
def q_drop_null_pairs(spark, d):
    return cl.drop_null_pairs(fx.holey_lines(spark, d)).select("row_id", "src", "tgt")


@query(
    "drop_empty_pairs",
    cte(h=HOLEY) + "SELECT row_id, src, tgt FROM h WHERE src IS NOT NULL AND src <> '' AND tgt IS NOT NULL AND tgt <> ''",
)
def q_drop_empty_pairs(spark, d):
    return cl.drop_empty_pairs(fx.holey_lines(spark, d)).select("row_id", "src", "tgt")


@query(
    "min_words",
    cte(p=P) + f"SELECT row_id, {sql_wc('src')} AS src_words, {sql_wc('tgt')} AS tgt_words FROM p "
    f"WHERE {sql_wc('src')} >= 3 AND {sql_wc('tgt')} >= 3",
)
def q_min_words(spark, d):
    p = cl.min_words(fx.parallel_lines(spark, d), 3)
    return p.select("row_id", tx.word_count("src").alias("src_words"), tx.word_count("tgt").alias("tgt_words"))


@query(
    "ratio_filter",
    cte(c=COUNTED_SQL) + "SELECT row_id, corpus, src_words, tgt_words, ratio FROM c WHERE ratio BETWEEN 0.75 AND 1.25",
)
def q_ratio_filter(spark, d):
    return cl.ratio_filter(counted_p(spark, d)).select("row_id", "corpus", "src_words", "tgt_words", "ratio")


@query(
    "length_ratio_clean",
    cte(p=P)
    + f"""
SELECT row_id, a AS n_src, b AS n_tgt FROM (
  SELECT row_id, {sql_wc('src')} AS a, {sql_wc('tgt')} AS b FROM p)
WHERE a BETWEEN 2 AND 350 AND b BETWEEN 2 AND 350
  AND CAST(greatest(a, b) AS DOUBLE) <= 2.0 * CAST(least(a, b) AS DOUBLE)
""",
)
def q_length_ratio_clean(spark, d):
    p = fx.parallel_lines(spark, d).select("row_id", tx.words("src").alias("a"), tx.words("tgt").alias("b"))
    out = cl.length_ratio_clean(p, "a", "b", 2, 350, 2.0)
    return out.select("row_id", F.size("a").cast("long").alias("n_src"), F.size("b").cast("long").alias("n_tgt"))
