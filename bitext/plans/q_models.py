"""Queries: subword merges and their application (AGG10-11, FLT5 on
subwords) and batch prediction with a caller's model (UDF3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids as idf
from ..functions import text as tx
from ..operators import bleu as ob
from ..operators import bpe
from ..operators import clean as cl
from ..operators import vocab as vb
from ..operators.predict import BigramStep, LookupPredictor, decode_loop, predict_with
from ..scratch import new_folder, remove, written
from .q_bleu import D, M, sql_bleu, sql_stats
from .q_text import CLEAN_P_SQL, clean_p
from .q_vocab import BASE_TOK, MAX_TOKENS, PADDED, SEQ_LEN, encode_sql, padded, sql_ids, sql_std, vocab_sql
from .registry import WS_RUN, full_query, query

# Fixed values of the queries.
BPE_MERGES = 24            # merges of the second, small queries that the oracle follows, one CTE per merge
BPE_MERGES_LONG = 10_000   # merges of ``bpe_vocabulary`` and the ``..._full`` queries, as in the reference
BPE_MIN_FREQ = 2
LOOKUP_SIZE = 1000         # ids below this map to themselves, the rest to unk


def _sql_pre(side: str) -> str:
    classes = f"[{tx.WORD_CLASS}]+|[^{tx.WORD_CLASS}{tx.SPACE_CLASS}]+"
    return f"regexp_extract_all(lower({side}), '\\[start\\]|\\[end\\]|{classes}')"


def _bpe_sql(k: int) -> str:
    """CTEs: words w0, the best pair p1 and the rewritten words w1, and so on."""
    steps = [
        f"c AS MATERIALIZED ({CLEAN_P_SQL})",
        f"words AS (SELECT unnest({_sql_pre('src')}) AS word FROM c "
        f"UNION ALL SELECT unnest({_sql_pre('tgt')}) FROM c)",
        "w0 AS MATERIALIZED (SELECT word, count(*) AS f, regexp_replace(word, '(.)', ' \\1 ', 'g') AS sym "
        "FROM words GROUP BY word)",
    ]
    for i in range(1, k + 1):
        steps.append(
            f"p{i} AS MATERIALIZED (SELECT l, r, CAST(sum(f) AS BIGINT) AS n FROM (SELECT f, unnest(s[:-2]) AS l, "
            f"unnest(s[2:]) AS r FROM (SELECT f, string_split(trim(sym), '  ') AS s FROM w{i - 1}) WHERE len(s) > 1) "
            f"GROUP BY l, r HAVING sum(f) >= {BPE_MIN_FREQ} ORDER BY n DESC, l, r LIMIT 1)"
        )
        steps.append(
            f"w{i} AS MATERIALIZED (SELECT word, f, CASE WHEN l IS NULL THEN sym ELSE "
            f"replace(sym, ' ' || l || '  ' || r || ' ', ' ' || l || r || ' ') END AS sym FROM w{i - 1} LEFT JOIN p{i} ON true)"
        )
    return "WITH " + ",\n".join(steps) + "\n"


_LEARN_SQL = _bpe_sql(BPE_MERGES) + "\nUNION ALL ".join(
    f'SELECT CAST({i} AS INTEGER) AS rank, l AS "left", r AS "right", n FROM p{i}'
    for i in range(1, BPE_MERGES + 1)
)


def _segmented_sql(side: str) -> str:
    return (
        f"(SELECT row_id, list(u ORDER BY i, j) AS u FROM (SELECT row_id, i, unnest(string_split(trim(sym), '  ')) AS u, "
        f"unnest(range(len(string_split(trim(sym), '  ')))) AS j FROM (SELECT row_id, unnest({_sql_pre(side)}) AS word, "
        f"unnest(range(len({_sql_pre(side)}))) AS i FROM c) JOIN w{BPE_MERGES} USING (word)) GROUP BY row_id)"
    )


def word_lines(spark, d):
    """(row_id, s, t): the lower-cased, pre-tokenised words of both sides, one space apart
    (no word holds white space)."""
    words = lambda side: F.array_join(tx.pretokenize(tx.lower(side)), " ")
    return clean_p(spark, d).select("row_id", words("src").alias("s"), words("tgt").alias("t"))


def word_freqs(spark, d, lines=None):
    """(word, freq) over both sides: lower-cased, pre-tokenised words (of ``word_lines``)."""
    lines = word_lines(spark, d) if lines is None else lines
    return vb.token_counts(lines, ["s", "t"]).withColumnRenamed("token", "word")


def _merges(spark, d, k):
    merges = bpe.learn_merges(word_freqs(spark, d), k, BPE_MIN_FREQ)
    return bpe.merges_frame(spark, merges)


@query("bpe_learn", _LEARN_SQL)
def q_bpe_learn(spark, d):
    return _merges(spark, d, BPE_MERGES)


@query("bpe_vocabulary")
def q_bpe_vocabulary(spark, d):
    return _merges(spark, d, BPE_MERGES_LONG)


def _segmented(spark, d, merges, mark=None, sides=("s", "t"), folder=None):
    """Texts are cleaned and cut into words once, for the words' counts and the lines, and dealt
    by key then: the shuffle's files are gone before the subwords are written."""
    rows = F.count(F.lit(1)).over(Window.partitionBy("row_id"))
    lines = written(word_lines(spark, d).withColumn("rows", rows), "lines", folder)
    learned, words = bpe.learn_words(word_freqs(spark, d, lines), merges, BPE_MIN_FREQ)
    return bpe.segment_words(lines, "row_id", {x: F.col(x) for x in sides}, words, mark, learned, mark is not None, "rows")


def subwords(spark, d, merges=BPE_MERGES, sides=("s", "t")):
    """(row_id, s, t): the subwords of both sides, or of the ``sides`` given, of every line;
    merges are learned from both."""
    return _segmented(spark, d, merges, sides=sides)


@query(
    "bpe_apply",
    _bpe_sql(BPE_MERGES)
    + "SELECT row_id, CAST(coalesce(len(u), 0) AS BIGINT) AS n_subwords, coalesce(array_to_string(u, ' '), '') AS subwords "
    + f"FROM c LEFT JOIN {_segmented_sql('tgt')} USING (row_id)",
)
def q_bpe_apply(spark, d, merges=BPE_MERGES):
    sw = subwords(spark, d, merges, ["t"])
    return sw.select(
        "row_id", F.size("t").cast("long").alias("n_subwords"), F.array_join("t", " ").alias("subwords")
    )


@full_query("bpe_apply_full")
def q_bpe_apply_full(spark, d):
    return q_bpe_apply(spark, d, BPE_MERGES_LONG)


@query(
    "subword_length_clean",
    _bpe_sql(BPE_MERGES)
    + "SELECT row_id, CAST(a AS BIGINT) AS n_src, CAST(b AS BIGINT) AS n_tgt FROM (SELECT c.row_id, len(s.u) AS a, len(t.u) AS b "
    + f"FROM c JOIN {_segmented_sql('src')} s USING (row_id) JOIN {_segmented_sql('tgt')} t USING (row_id)) "
    + "WHERE a BETWEEN 2 AND 350 AND b BETWEEN 2 AND 350 AND greatest(a, b) <= 2.0 * least(a, b)",
)
def q_subword_length_clean(spark, d, merges=BPE_MERGES):
    sw = subwords(spark, d, merges)
    out = cl.length_ratio_clean(sw, "s", "t", 2, 350, 2.0)
    return out.select("row_id", F.size("s").cast("long").alias("n_src"), F.size("t").cast("long").alias("n_tgt"))


@full_query("subword_length_clean_full")
def q_subword_length_clean_full(spark, d):
    return q_subword_length_clean(spark, d, BPE_MERGES_LONG)


# ---- subword ids (AGG11, ARR7): one vocabulary over the target's subwords
SUBWORD_MARKS = ("[START]", "[END]")
_SUBWORD_TOK = (
    _bpe_sql(BPE_MERGES)
    + f", tok AS (SELECT row_id, list_concat(['[START]'], coalesce(u, CAST([] AS VARCHAR[])), ['[END]']) AS toks "
    + f"FROM c LEFT JOIN {_segmented_sql('tgt')} USING (row_id)), voc AS ({vocab_sql(MAX_TOKENS)}), enc AS ({encode_sql('voc')})\n"
)


def subword_tokens(spark, d, merges=BPE_MERGES):
    start, end = (F.array(F.lit(m)) for m in SUBWORD_MARKS)
    return subwords(spark, d, merges, ["t"]).select("row_id", F.concat(start, "t", end).alias("toks"))


def whole_subword_ids(spark, d, merges):
    """(row_id, ids of the whole line) and the vocabulary."""
    toks = written(subword_tokens(spark, d, merges), "tokens")
    voc = written(vb.build_vocab(toks, "toks", max_tokens=MAX_TOKENS), "vocabulary")
    return vb.encode(toks, ["row_id"], "toks", voc, max_tokens=MAX_TOKENS, unique=True), voc


def subword_ids(spark, d, merges=BPE_MERGES):
    """(row_id, ids padded to SEQ_LEN) and the vocabulary."""
    ids, voc = whole_subword_ids(spark, d, merges)
    return ids.select("row_id", idf.pad_truncate("ids", SEQ_LEN).alias("ids")), voc


@query("bpe_encode_ids", _SUBWORD_TOK + PADDED + f"SELECT row_id, {sql_ids('ids')} AS ids FROM pad")
def q_bpe_encode_ids(spark, d):
    ids, _ = subword_ids(spark, d)
    return ids.select("row_id", tx.array_to_text("ids").alias("ids"))


@full_query("bpe_encode_ids_full")
def q_bpe_encode_ids_full(spark, d):
    """Padded and cut to SEQ_LEN like the reference's ``tokenize_and_pad``."""
    ids, _ = subword_ids(spark, d, BPE_MERGES_LONG)
    return ids.select("row_id", tx.array_to_text("ids").alias("ids"))


@query(
    "bpe_decode",
    _SUBWORD_TOK + PADDED
    + """SELECT p.row_id, coalesce(string_agg(v.token, ' ' ORDER BY u.pos)
         FILTER (WHERE v.token IS NOT NULL AND u.id <> 0 AND v.token NOT IN ('[START]', '[END]')), '') AS text
FROM pad p
LEFT JOIN (SELECT row_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM pad) u ON p.row_id = u.row_id
LEFT JOIN voc v ON u.id = v.id
GROUP BY p.row_id""",
)
def q_bpe_decode(spark, d):
    return _decoded(*subword_ids(spark, d))


def _decoded(ids, voc):
    plain = voc.where(~F.col("token").isin(list(SUBWORD_MARKS)))  # the marks are skipped like padding
    return vb.decode(ids, ["row_id"], "ids", plain, max_tokens=MAX_TOKENS, unique=True)


@full_query("bpe_decode_full")
def q_bpe_decode_full(spark, d):
    """Every line whole: decoding the ids before they are padded."""
    return _decoded(*whole_subword_ids(spark, d, BPE_MERGES_LONG))


# ---- reversible subwords (AGG11, ARR7): a mark on every symbol that its word goes on after
SUBWORD_TOKENS = 60_000  # a vocabulary that holds every subword, marked and unmarked, of 10,000 merges
_MARK_SQL = f"chr({ord(bpe.CONTINUES)})"


def _marked_sql(side: str) -> str:
    cut = "string_split(trim(sym), '  ')"
    return (
        f"(SELECT row_id, list(CASE WHEN j < n - 1 THEN u || {_MARK_SQL} ELSE u END ORDER BY i, j) AS u FROM (SELECT row_id, i, "
        f"unnest({cut}) AS u, unnest(range(len({cut}))) AS j, len({cut}) AS n FROM (SELECT row_id, unnest({_sql_pre(side)}) AS word, "
        f"unnest(range(len({_sql_pre(side)}))) AS i FROM c) JOIN w{BPE_MERGES} USING (word)) GROUP BY row_id)"
    )


def marked_subwords(spark, d, merges=BPE_MERGES):
    """(row_id, s, t): the marked subwords of both sides of every line, one space apart, written."""
    folder = new_folder(spark, "lines")
    marked = written(_segmented(spark, d, merges, bpe.CONTINUES, folder=folder), "marked")
    remove(spark, folder)
    return marked


def subword_text(spark, d, merges=BPE_MERGES, cut: int | None = None):
    """(row_id, src, tgt): both sides encoded into ids of one joint vocabulary, padded and
    cut to ``cut`` ids if given, and decoded to words."""
    both, sides = marked_subwords(spark, d, merges), ["src", "tgt"]
    voc = written(vb.build_vocab(both, ["s", "t"], max_tokens=SUBWORD_TOKENS), "subwords")
    ids = vb.encode(both, ["row_id"], ["s", "t"], voc, sides, max_tokens=SUBWORD_TOKENS, unique=True)
    if cut is not None:
        ids = ids.select("row_id", *[idf.pad_truncate(side, cut).alias(side) for side in sides])
    text = vb.decode(ids, ["row_id"], sides, voc, sides, max_tokens=SUBWORD_TOKENS, unique=True)
    return text.select("row_id", *[bpe.join_subwords(side).alias(side) for side in sides])


@query(
    "bpe_round_trip",
    f"WITH c AS ({CLEAN_P_SQL}) SELECT row_id, array_to_string({_sql_pre('src')}, ' ') AS src, "
    f"array_to_string({_sql_pre('tgt')}, ' ') AS tgt FROM c",
)
def q_bpe_round_trip(spark, d):
    """Decoding the ids of every whole line at 10,000 merges gives its words back."""
    return subword_text(spark, d, BPE_MERGES_LONG)


def _decoded_sql(side: str) -> str:
    return (
        f"(SELECT p.row_id, rtrim(replace(coalesce(string_agg(v.token, ' ' ORDER BY p.pos), ''), {_MARK_SQL} || ' ', ''), {_MARK_SQL}) AS text "
        f"FROM (SELECT row_id, unnest(u[1:{SEQ_LEN}]) AS token, unnest(range(least(len(u), {SEQ_LEN}))) AS pos FROM m_{side}) p "
        "JOIN voc v USING (token) GROUP BY p.row_id)"
    )


@query(
    "bleu_subword_m4",
    _bpe_sql(BPE_MERGES)
    + f", m_src AS MATERIALIZED {_marked_sql('src')}, m_tgt AS MATERIALIZED {_marked_sql('tgt')}, "
    + f"tok AS (SELECT u AS toks FROM m_src UNION ALL SELECT u FROM m_tgt), voc AS MATERIALIZED ({vocab_sql(SUBWORD_TOKENS)}), "
    + f"b0 AS (SELECT c.row_id, regexp_extract_all(coalesce(h.text, ''), '{WS_RUN}') AS h, regexp_extract_all(coalesce(r.text, ''), '{WS_RUN}') AS r "
    + f"FROM c LEFT JOIN {_decoded_sql('src')} h ON c.row_id = h.row_id LEFT JOIN {_decoded_sql('tgt')} r ON c.row_id = r.row_id)"
    + sql_stats("b0")
    + f"SELECT row_id, hyp_len, ref_len, round({sql_bleu('hyp_len', 'ref_len', M, D, 'method4')}, 6) AS bleu FROM st",
)
def q_bleu_subword_m4(spark, d, merges=BPE_MERGES):
    """Sentence BLEU (method 4) of words decoded from subword ids, both sides cut to SEQ_LEN ids."""
    text = subword_text(spark, d, merges, SEQ_LEN)  # its words stand one space apart
    scored = ob.sentence_bleu(text, "row_id", "src", "tgt", "method4", unique=True)
    return scored.select("row_id", "hyp_len", "ref_len", F.round("score", 6).alias("bleu"))


@full_query("bleu_subword_m4_full")
def q_bleu_subword_m4_full(spark, d):
    return q_bleu_subword_m4(spark, d, BPE_MERGES_LONG)


@query(
    "predict_batches",
    BASE_TOK + PADDED
    + f"SELECT row_id, array_to_string(list_transform(ids, lambda x: CASE WHEN x >= 0 AND x < {LOOKUP_SIZE} "
    f"THEN x ELSE 1 END), ' ') AS pred_ids FROM pad",
)
def q_predict_batches(spark, d):
    """The model is built once per worker."""

    def make():
        return LookupPredictor({i: i for i in range(LOOKUP_SIZE)}, default=1)

    pred = predict_with(padded(spark, d), ["row_id"], "ids", make, SEQ_LEN, batch_size=256)
    return pred.select("row_id", tx.array_to_text("pred_ids").alias("pred_ids"))


# ---- greedy decoding with a model in the loop (UDF4)
MAX_DECODE = 40  # decode cap of the reference's translate loop

_FIRST_SQL = f"SELECT row_id, ({sql_std('src')})[1] AS token FROM ({CLEAN_P_SQL})"


@query(
    "decode_loop",
    BASE_TOK.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", n AS (SELECT a, b, count(*) AS n FROM (SELECT unnest(ids[1:len(ids) - 1]) AS a, unnest(ids[2:]) AS b FROM enc) GROUP BY a, b),
nxt AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn FROM n) WHERE rn = 1),
stop AS (SELECT id AS stop FROM voc WHERE token = '[end]'),
f AS (SELECT row_id, CASE WHEN t.token IS NULL THEN 0 ELSE coalesce(v.id, 1) END AS id FROM ({_FIRST_SQL}) t LEFT JOIN voc v ON t.token = v.token),
loop AS (SELECT row_id, 1 AS step, coalesce(b, stop) AS id FROM f LEFT JOIN nxt ON f.id = nxt.a, stop
         UNION ALL
         SELECT row_id, step + 1, coalesce(b, stop) FROM loop LEFT JOIN nxt ON loop.id = nxt.a, stop
         WHERE loop.id <> stop AND step < {MAX_DECODE}),
kept AS (SELECT row_id, step, id FROM loop, stop WHERE id <> stop)
SELECT f.row_id, CAST(count(k.id) AS BIGINT) AS n_tokens, coalesce(string_agg(CAST(k.id AS VARCHAR), ' ' ORDER BY k.step), '') AS ids
FROM f LEFT JOIN kept k ON f.row_id = k.row_id GROUP BY f.row_id""",
)
def q_decode_loop(spark, d):
    """Every source line is decoded by a bigram model of the target side, one token a step."""
    toks = written(
        clean_p(spark, d).select(
            "row_id", tx.standardize_words(tx.wrap_markers("tgt")).alias("toks"), tx.standardize_words("src").alias("source")
        ),
        "tokens",
    )
    voc = written(vb.build_vocab(toks, "toks", max_tokens=MAX_TOKENS), "vocabulary")
    marks = {r.token: r.id for r in voc.where(F.col("token").isin(tx.START_MARK, tx.END_MARK)).collect()}
    ids = vb.encode(toks, ["row_id"], "toks", voc, max_tokens=MAX_TOKENS)
    pairs = ids.select(F.explode(F.arrays_zip(F.expr("slice(ids, 1, size(ids) - 1)").alias("a"), F.expr("slice(ids, 2, size(ids))").alias("b"))).alias("p"))
    counts = pairs.where(F.col("p.b").isNotNull()).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("a").agg(F.max_by("b", F.struct(F.col("n"), -F.col("b"))).alias("b"))
    table = spark.sparkContext.broadcast({r.a: r.b for r in best.collect()})  # at most a row per id of the vocabulary
    end = marks[tx.END_MARK]

    def make():
        return BigramStep(table.value, end)

    source = vb.encode(toks.select("row_id", "source"), ["row_id"], "source", voc, max_tokens=MAX_TOKENS)
    out = decode_loop(source, ["row_id"], "ids", make, marks[tx.START_MARK], end, MAX_DECODE)
    return out.select("row_id", F.size("ids").cast("long").alias("n_tokens"), tx.array_to_text("ids").alias("ids"))
