"""Queries: vocabularies, id encoding, padding, shifting, masks, decoding,
batches, dictionary report (AGG5-7, ARR1-9, FLT6-7, FLT9-10, STR15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids as idf
from ..functions import text as tx
from ..operators import measure as me
from ..operators.batches import with_batch
from ..operators import vocab as vb
from ..scratch import written
from .q_split import BASE, SET3_SQL, recipe3
from .q_text import CLEAN_P_SQL, clean_p
from .registry import WS_RUN, cte, query, sql_words

# Fixed values of the queries.
MAX_TOKENS = 20000       # vectoriser max_tokens
SMALL_VOCAB = 500        # a capped vocabulary, so that out-of-vocabulary words occur
SEQ_LEN = 30             # output_sequence_length
BATCH = 64

_PUNCT_SQL = tx.ASCII_PUNCT_CLASS.replace("'", "''")


def sql_std(x: str) -> str:
    """STR16 in DuckDB: lower, split, strip ASCII punctuation (markers kept)."""
    return (
        f"list_filter(list_transform(regexp_extract_all(lower({x}), '{WS_RUN}'), "
        f"lambda t: CASE WHEN t IN ('[start]', '[end]') THEN t ELSE regexp_replace(t, '{_PUNCT_SQL}', '', 'g') END), "
        f"lambda t: t <> '')"
    )


def sql_ids(lst: str) -> str:
    return f"array_to_string({lst}, ' ')"


# token table: standardised target side with markers, per cleaned row
_WRAPPED = "concat_ws(' ', '[start]', tgt, '[end]')"
TOK_SQL = f"SELECT row_id, {sql_std(_WRAPPED)} AS toks FROM ({CLEAN_P_SQL})"


def vocab_sql(cap: int, first_id: int = 2, tok: str = "tok", col: str = "toks") -> str:
    return f"""
SELECT token, freq, id FROM (
  SELECT token, freq, CAST(row_number() OVER (ORDER BY freq DESC, token) + {first_id - 1} AS INTEGER) AS id
  FROM (SELECT token, count(*) AS freq FROM (SELECT unnest({col}) AS token FROM {tok}) GROUP BY token))
WHERE id < {cap}
"""


def encode_sql(voc: str, drop_oov: bool = False) -> str:
    """row_id, ids (list) of the tok table through vocabulary ``voc``."""
    idv = "v.id" if drop_oov else "coalesce(v.id, 1)"
    cond = "u.pos IS NOT NULL" + (" AND v.id IS NOT NULL" if drop_oov else "")
    return f"""
SELECT t.row_id, coalesce(list({idv} ORDER BY u.pos) FILTER (WHERE {cond}), []) AS ids
FROM tok t
LEFT JOIN (SELECT row_id, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM tok) u ON t.row_id = u.row_id
LEFT JOIN {voc} v ON u.token = v.token
GROUP BY t.row_id
"""


def tokens(spark, d):
    p = clean_p(spark, d)
    return p.select("row_id", tx.standardize_words(tx.wrap_markers("tgt")).alias("toks"))


def vocab(spark, d, cap=MAX_TOKENS, toks=None):
    return vb.build_vocab(toks if toks is not None else tokens(spark, d), "toks", max_tokens=cap)


def encoded_with(spark, d, cap=MAX_TOKENS, drop_oov=False):
    """The ids and the vocabulary."""
    # the token table feeds the vocabulary and the encoding: build it once
    toks = written(tokens(spark, d), "tokens")
    voc = written(vocab(spark, d, cap, toks), "vocabulary")
    return vb.encode(toks, ["row_id"], "toks", voc, drop_oov=drop_oov, max_tokens=cap), voc


def encoded(spark, d, cap=MAX_TOKENS, drop_oov=False):
    return encoded_with(spark, d, cap, drop_oov)[0]


def padded(spark, d):
    return encoded(spark, d).select("row_id", idf.pad_truncate("ids", SEQ_LEN).alias("ids"))


BASE_TOK = cte(tok=TOK_SQL) + f", voc AS ({vocab_sql(MAX_TOKENS)}), enc AS ({encode_sql('voc')})\n"
PADDED = f", pad AS (SELECT row_id, list_resize(ids, {SEQ_LEN}, 0) AS ids FROM enc)\n"


@query("vocab_word", cte(tok=TOK_SQL) + vocab_sql(MAX_TOKENS))
def q_vocab_word(spark, d):
    return vocab(spark, d)


@query(
    "vocab_ws",
    cte(tok=f"SELECT row_id, {sql_words('lower(src)')} AS toks FROM ({CLEAN_P_SQL})") + vocab_sql(10**9, first_id=1),
)
def q_vocab_ws(spark, d):
    toks = clean_p(spark, d).select(tx.words(tx.lower("src")).alias("toks"))
    return vb.build_vocab(toks, "toks", first_id=1)


@query("encode_ids", BASE_TOK + f"SELECT row_id, {sql_ids('ids')} AS ids FROM enc")
def q_encode_ids(spark, d):
    return encoded(spark, d).select("row_id", tx.array_to_text("ids").alias("ids"))


@query(
    "encode_drop_oov",
    cte(tok=TOK_SQL) + f", voc AS ({vocab_sql(SMALL_VOCAB)}), enc AS ({encode_sql('voc', True)})\n"
    + f"SELECT row_id, {sql_ids('ids')} AS ids FROM enc",
)
def q_encode_drop_oov(spark, d):
    e = encoded(spark, d, cap=SMALL_VOCAB, drop_oov=True)
    return e.select("row_id", tx.array_to_text("ids").alias("ids"))


@query(
    "pad_truncate",
    BASE_TOK
    + f"""SELECT row_id, {sql_ids(f'list_resize(ids, {SEQ_LEN}, 0)')} AS ids_post,
       {sql_ids(f'CASE WHEN len(ids) > {SEQ_LEN} THEN ids[len(ids) - {SEQ_LEN - 1}:] ELSE list_resize(ids, {SEQ_LEN}, 0) END')} AS ids_pre
FROM enc""",
)
def q_pad_truncate(spark, d):
    e = encoded(spark, d)
    return e.select(
        "row_id",
        tx.array_to_text(idf.pad_truncate("ids", SEQ_LEN, "post")).alias("ids_post"),
        tx.array_to_text(idf.pad_truncate("ids", SEQ_LEN, "pre")).alias("ids_pre"),
    )


@query(
    "teacher_forcing",
    BASE_TOK
    + f"""SELECT row_id, {sql_ids(f'list_resize(ids, {SEQ_LEN + 1}, 0)[1:{SEQ_LEN}]')} AS decoder_input,
       {sql_ids(f'list_resize(ids, {SEQ_LEN + 1}, 0)[2:{SEQ_LEN + 1}]')} AS label
FROM enc""",
)
def q_teacher_forcing(spark, d):
    e = encoded(spark, d).select("row_id", idf.pad_truncate("ids", SEQ_LEN + 1).alias("ids"))
    return e.select(
        "row_id",
        tx.array_to_text(idf.decoder_input("ids")).alias("decoder_input"),
        tx.array_to_text(idf.shifted_label("ids")).alias("label"),
    )


@query(
    "padding_mask",
    BASE_TOK + PADDED
    + f"SELECT row_id, {sql_ids('list_transform(ids, lambda x: CASE WHEN x = 0 THEN 1 ELSE 0 END)')} AS mask FROM pad",
)
def q_padding_mask(spark, d):
    p = padded(spark, d)
    return p.select("row_id", tx.array_to_text(F.transform(idf.padding_mask("ids"), lambda x: x.cast("int"))).alias("mask"))


@query(
    "strip_pad",
    BASE_TOK + PADDED + f"SELECT row_id, {sql_ids('list_filter(ids, lambda x: x <> 0)')} AS ids FROM pad",
)
def q_strip_pad(spark, d):
    return padded(spark, d).select("row_id", tx.array_to_text(idf.strip_pad("ids")).alias("ids"))


@query(
    "strip_specials",
    cte(tok=TOK_SQL)
    + "SELECT row_id, array_to_string(list_filter(toks, lambda t: t NOT IN ('[start]', '[end]')), ' ') AS words FROM tok",
)
def q_strip_specials(spark, d):
    t = tokens(spark, d)
    return t.select("row_id", F.array_join(idf.strip_values("toks", [tx.START_MARK, tx.END_MARK]), " ").alias("words"))


@query(
    "ids_to_text",
    BASE_TOK + PADDED
    + """SELECT p.row_id, coalesce(string_agg(v.token, ' ' ORDER BY u.pos) FILTER (WHERE v.token IS NOT NULL AND u.id <> 0), '') AS text
FROM pad p
LEFT JOIN (SELECT row_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM pad) u ON p.row_id = u.row_id
LEFT JOIN voc v ON u.id = v.id
GROUP BY p.row_id""",
)
def q_ids_to_text(spark, d):
    ids, voc = encoded_with(spark, d)
    cut = ids.select("row_id", idf.pad_truncate("ids", SEQ_LEN).alias("ids"))
    return vb.decode(cut, ["row_id"], "ids", voc, max_tokens=MAX_TOKENS, unique=True)


@query(
    "batch_rows",
    cte(c=CLEAN_P_SQL)
    + f"""SELECT row_id, pos // {BATCH} AS batch FROM (
  SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos, count(*) OVER () AS n FROM c)
WHERE pos < (n // {BATCH}) * {BATCH}""",
)
def q_batch_rows(spark, d):
    p = clean_p(spark, d).select("row_id")
    return with_batch(p, ["row_id"], BATCH, drop_remainder=True).select("row_id", "batch")


@query(
    "dict_report",
    BASE + SET3_SQL
    + f""", long AS (SELECT split, 'src' AS side, {sql_words('src')} AS toks FROM s3
               UNION ALL SELECT split, 'tgt', {sql_words('tgt')} FROM s3),
tk AS (SELECT split, side, unnest(toks) AS token FROM long),
v AS (SELECT DISTINCT side, token FROM tk WHERE split = 'train'),
types AS (SELECT side, count(*) AS types FROM v GROUP BY side),
unk AS (SELECT split, side, count(*) AS n_unk FROM tk
        WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.side = tk.side AND v.token = tk.token) GROUP BY 1, 2),
bs AS (SELECT split, side, count(*) AS sents, CAST(sum(len(toks) + 1) AS BIGINT) AS tokens FROM long GROUP BY 1, 2)
SELECT bs.split, bs.side, sents, tokens, CAST(coalesce(n_unk, 0) AS BIGINT) AS n_unk,
       round(CAST(coalesce(n_unk, 0) AS DOUBLE) * 100.0 / tokens, 2) AS unk_pct,
       CAST(coalesce(types, 0) AS BIGINT) AS types
FROM bs LEFT JOIN unk ON bs.split = unk.split AND bs.side = unk.side LEFT JOIN types ON bs.side = types.side
""",
)
def q_dict_report(spark, d):
    s = recipe3(spark, d).select("split", tx.clean_words("src").alias("s"), tx.clean_words("tgt").alias("t"))
    return vb.dictionary_report(s, {"src": "s", "tgt": "t"})
