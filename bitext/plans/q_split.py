"""Queries: samples, splits, recipes, anti-join, union, alignment (SPL1-8,
SET1, JOI1-2).

Corpus A = the 'ai' rows, corpus B = the 'pro' rows of the cleaned,
ratio-filtered parallel lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as cl
from ..operators import split as sp
from ..scratch import written
from . import fixtures as fx
from .q_text import COUNTED_SQL, counted_p
from .registry import cte, query

# Seeds and the reference's recipe sizes.
SEED_SAMPLE = 1        # sample(random_state=1)
SEED_SPLIT = 42        # train_test_split(random_state=42)
SEED_SHUFFLE = 7
TEST_FRACTION = 0.2
SET2_VALID = 2000
SET2_TEST = 2000
SET3_A, SET3_A_OF = 18000, 20810   # 18,000 of 20,810 filtered A rows
SET3_B, SET3_B_OF = 3000, 4111     # 3,000 of 4,111 filtered B rows


def filtered(spark, d):
    """Both corpora after cleaning and the ratio band (written: every
    recipe reads it several times and needs its row counts)."""
    return written(cl.ratio_filter(counted_p(spark, d)).select("row_id", "corpus", "src", "tgt"), "filtered")


def corpora(spark, d):
    f = filtered(spark, d)
    return f.where(F.col("corpus") == "ai"), f.where(F.col("corpus") == "pro")


FILTERED_SQL = f"SELECT row_id, corpus, src, tgt FROM ({COUNTED_SQL}) WHERE ratio BETWEEN 0.75 AND 1.25"


def sql_hash(seed) -> str:
    return (
        f"CAST('0x' || substr(md5('{seed}' || ':' || corpus || ':' || CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT)"
    )


def sql_draw(src: str, seed) -> str:
    """rows of ``src`` with their 0-based draw position."""
    return (
        f"SELECT *, row_number() OVER (ORDER BY {sql_hash(seed)}, corpus, row_id) - 1 AS pos FROM {src}"
    )


BASE = cte(f=FILTERED_SQL) + ", a AS (SELECT * FROM f WHERE corpus = 'ai'), b AS (SELECT * FROM f WHERE corpus = 'pro')\n"


# ---------------------------------------------------------------- SPL1..SPL4
@query(
    "split_fraction",
    BASE
    + f""", d AS ({sql_draw('f', SEED_SPLIT)}),
n AS (SELECT CAST(ceil(CAST({TEST_FRACTION} AS DOUBLE) * count(*)) AS BIGINT) AS n_test FROM f)
SELECT row_id, corpus, CASE WHEN pos < n_test THEN 'test' ELSE 'train' END AS split FROM d, n
""",
)
def q_split_fraction(spark, d):
    return sp.split_fraction(filtered(spark, d), TEST_FRACTION, SEED_SPLIT).select("row_id", "corpus", "split")


@query(
    "sample_exact",
    BASE + f", d AS ({sql_draw('a', SEED_SAMPLE)})\nSELECT row_id, corpus FROM d WHERE pos < (SELECT count(*) FROM b)",
)
def q_sample_exact(spark, d):
    a, b = corpora(spark, d)
    return sp.sample_exact(a, b.count(), SEED_SAMPLE).select("row_id", "corpus")


@query(
    "remaining_rows",
    BASE
    + f""", d AS ({sql_draw('a', SEED_SAMPLE)}),
s AS (SELECT corpus, row_id FROM d WHERE pos < (SELECT count(*) FROM b))
SELECT row_id, corpus FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.corpus = a.corpus AND s.row_id = a.row_id)
""",
)
def q_remaining_rows(spark, d):
    a, b = corpora(spark, d)
    return sp.remaining(a, sp.sample_exact(a, b.count(), SEED_SAMPLE)).select("row_id", "corpus")


@query(
    "split_half",
    BASE
    + f""", d AS ({sql_draw('b', SEED_SPLIT)}),
n AS (SELECT CAST(ceil(CAST(0.5 AS DOUBLE) * count(*)) AS BIGINT) AS n_test FROM b)
SELECT row_id, corpus, CASE WHEN pos < n_test THEN 'test' ELSE 'valid' END AS split FROM d, n
""",
)
def q_split_half(spark, d):
    _, b = corpora(spark, d)
    return sp.split_half(b, SEED_SPLIT).select("row_id", "corpus", "split")


def set2_sizes(n_a: int) -> tuple[int, int]:
    """The reference's 2,000 + 2,000 as shares of its filtered corpus."""
    return n_a * SET2_VALID // SET3_A_OF, n_a * SET2_TEST // SET3_A_OF


_SET2_SQL = f""", d AS ({sql_draw('a', SEED_SAMPLE)}),
s AS (SELECT * FROM d WHERE pos < (SELECT count(*) FROM b)),
rest AS (SELECT row_id, corpus, src, tgt FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.corpus = a.corpus AND s.row_id = a.row_id)),
k AS (SELECT count(*) * {SET2_VALID} // {SET3_A_OF} AS kv, count(*) * {SET2_TEST} // {SET3_A_OF} AS kt FROM a),
r AS ({sql_draw('rest', SEED_SAMPLE)}),
vt AS (SELECT row_id, corpus, CASE WHEN pos < kv THEN 'valid' WHEN pos < kv + kt THEN 'test' END AS split FROM r, k)
"""


@query("split_absolute", BASE + _SET2_SQL + "SELECT row_id, corpus, split FROM vt WHERE split IS NOT NULL")
def q_split_absolute(spark, d):
    a, b = corpora(spark, d)
    rest = sp.remaining(a, sp.sample_exact(a, b.count(), SEED_SAMPLE))
    kv, kt = set2_sizes(a.count())
    return sp.split_counts(rest, SEED_SAMPLE, [kv, kt], ["valid", "test"]).select("row_id", "corpus", "split")


# ---------------------------------------------------------------- recipes
@query(
    "recipe_set1",
    BASE
    + f""", d AS ({sql_draw('b', SEED_SPLIT)}),
n AS (SELECT CAST(ceil(CAST(0.5 AS DOUBLE) * count(*)) AS BIGINT) AS n_test FROM b)
SELECT row_id, corpus, 'train' AS split FROM a
UNION ALL SELECT row_id, corpus, CASE WHEN pos < n_test THEN 'test' ELSE 'valid' END FROM d, n
""",
)
def q_recipe_set1(spark, d):
    a, b = corpora(spark, d)
    return sp.recipe_set1(a, b, SEED_SPLIT).select("row_id", "corpus", "split")


@query(
    "recipe_set2",
    BASE
    + _SET2_SQL
    + """SELECT row_id, corpus, 'train' AS split FROM b
UNION ALL SELECT row_id, corpus, 'train' FROM s
UNION ALL SELECT row_id, corpus, split FROM vt WHERE split IS NOT NULL
""",
)
def q_recipe_set2(spark, d):
    a, b = corpora(spark, d)
    kv, kt = set2_sizes(a.count())
    return sp.recipe_set2(a, b, SEED_SAMPLE, kv, kt).select("row_id", "corpus", "split")


def set3_sizes(n_a: int, n_b: int) -> tuple[int, int]:
    """The reference's 18,000 / 3,000 as shares of its filtered corpora."""
    return n_a * SET3_A // SET3_A_OF, n_b * SET3_B // SET3_B_OF


SET3_SQL = f""", da AS ({sql_draw('a', SEED_SAMPLE)}), db AS ({sql_draw('b', SEED_SAMPLE)}),
na AS (SELECT count(*) * {SET3_A} // {SET3_A_OF} AS k FROM a),
nb AS (SELECT count(*) * {SET3_B} // {SET3_B_OF} AS k FROM b),
s3 AS (SELECT row_id, corpus, src, tgt, CASE WHEN pos < k THEN 'train' ELSE 'valid' END AS split FROM da, na
       UNION ALL
       SELECT row_id, corpus, src, tgt, CASE WHEN pos < k THEN 'train' ELSE 'test' END FROM db, nb)
"""


def recipe3(spark, d):
    a, b = corpora(spark, d)
    n_a, n_b = set3_sizes(a.count(), b.count())
    return sp.recipe_set3(a, b, SEED_SAMPLE, n_a, n_b)


@query("recipe_set3", BASE + SET3_SQL + "SELECT row_id, corpus, split FROM s3")
def q_recipe_set3(spark, d):
    return recipe3(spark, d).select("row_id", "corpus", "split")


# ---------------------------------------------------------------- SPL8, SET1, JOI1
@query("shuffle_rows", BASE + f", d AS ({sql_draw('f', SEED_SHUFFLE)})\nSELECT row_id, corpus, pos FROM d")
def q_shuffle_rows(spark, d):
    return sp.draw_order(filtered(spark, d), SEED_SHUFFLE, "pos").select("row_id", "corpus", "pos")


@query("union_corpora", BASE + "SELECT row_id, corpus FROM a UNION ALL SELECT row_id, corpus FROM b")
def q_union_corpora(spark, d):
    a, b = corpora(spark, d)
    return sp.union_corpora(a, b).select("row_id", "corpus")


@query(
    "align_sides",
    cte(p=fx.P_SQL) + "SELECT s.row_id, s.src, t.tgt FROM (SELECT row_id, src FROM p) s JOIN (SELECT row_id, tgt FROM p) t ON s.row_id = t.row_id",
)
def q_align_sides(spark, d):
    p = fx.parallel_lines(spark, d)
    return p.select("row_id", "src").join(p.select("row_id", "tgt"), "row_id")
