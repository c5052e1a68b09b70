"""Registered queries of the training-data operators: each applies its
operator to the whole table; ``ORACLES`` has DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext.llm import (
    bpe_codec,
    chat_windows,
    decontaminate,
    exact_dedup,
    language_id,
    periodic_runs,
    pivot_clusters,
    quality,
    simhash,
    suffix_dedup,
    token_store,
    toxicity,
    warc_zst,
)
from bitext.llm.common import held_out
from bitext.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS_FILE = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    back = chat_windows.read_back(chat_windows.format_windows(rows))
    whole = back.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )
    turns = F.flatten(F.transform("w", lambda x: x["turns"]))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.flatten(F.transform("w", lambda x: x["loss"])), "")
    return whole.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql_escape(x: str) -> str:
    return f"regexp_replace({x}, '([<\\[])(\\\\*)({chat_windows.CONTROL_TAILS})', '\\1\\\\\\2\\3', 'g')"


def _sql_tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{chat_windows.TOKEN}'))"


_MARKS = len(chat_windows.START + chat_windows.SEP + chat_windows.END)

ORACLES["op1_chat_windows"] = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
     e AS (SELECT *, {_sql_escape('role')} AS er, {_sql_escape('text')} AS et FROM r),
     n AS (SELECT *, {_sql_tokens('er')} + {_sql_tokens('et')} + {chat_windows.TURN_TOKENS} AS k,
                  length(er) + length(et) + {_MARKS} AS c,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, er, et) AS pos FROM e),
     s AS (SELECT *, pos = 1 AND er = 'system' AS sys FROM n),
     p AS (SELECT *, first_value(CASE WHEN sys THEN k ELSE 0 END) OVER w AS sk,
                  first_value(CASE WHEN sys THEN c ELSE 0 END) OVER w AS sc,
                  sum(CASE WHEN sys THEN 0 ELSE k END) OVER w AS past FROM s
           WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
     q AS (SELECT *, greatest(1, {chat_windows.BUDGET - chat_windows.HISTORY_BUDGET} - sk) AS room FROM p),
     z AS (SELECT *, CASE WHEN sys THEN 0 ELSE (past - k) // room END AS a,
                  CASE WHEN sys THEN 0 ELSE (past - 1) // room END AS b FROM q),
     o AS (SELECT *, CASE WHEN pos = 1 THEN 1 WHEN sc > 0 AND pos = 2 THEN 0
                          WHEN a <> lag(a) OVER w OR b <> lag(b) OVER w THEN 1 ELSE 0 END AS opens,
                  lag(k) OVER w AS k1, lag(k, 2) OVER w AS k2, lag(c) OVER w AS c1, lag(c, 2) OVER w AS c2,
                  lag(sys) OVER w AS s1, lag(sys, 2) OVER w AS s2
           FROM z WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
     f AS (SELECT *, c + CASE WHEN opens = 1 AND pos > 1 THEN sc
                + CASE WHEN NOT coalesce(s1, true) AND k1 <= {chat_windows.HISTORY_BUDGET} THEN c1
                    + CASE WHEN NOT coalesce(s2, true) AND k1 + k2 <= {chat_windows.HISTORY_BUDGET} THEN c2 ELSE 0 END
                  ELSE 0 END ELSE 0 END AS chars FROM o)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


@_query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


_FOLDED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op2_exact_dedup"] = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_FOLDED.format('text')} AS t FROM documents)
"""


@_query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.with_occurrences(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        decontaminate.hit_words().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op3_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_FOLDED.format('text'))} AS w FROM documents),
     i AS (SELECT item_id, {_WORDS.format(_FOLDED.format('text'))} AS w FROM benchmark),
     iw AS (SELECT item_id, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p, w
            FROM i WHERE len(w) > 0),
     wins AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM iw),
     lens AS (SELECT DISTINCT n FROM wins),
     dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
     dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
            FROM dp, lens WHERE p + n - 1 <= len(w)),
     hits AS (SELECT doc_id, p, n, item_id FROM dw JOIN wins USING (n, g)),
     words AS (SELECT doc_id, count(DISTINCT q) AS n_hit
               FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _scored(scored: DataFrame, at_least: float) -> DataFrame:
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= at_least).cast("int").alias("predicted"),
    )


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(toxicity.with_score(docs, model), toxicity.TOXIC_SCORE)


@_query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    sizes = F.transform("removed", lambda s: s["past"] - s["first"])
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("removed") > 0).alias("repeated"),
    )


@_query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.fit(table(spark, sf_dir, "documents"))
    found = language_id.identify(table(spark, sf_dir, "pages"), model)
    return found.withColumn("confidence", F.round("confidence", 6))


@_query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dups(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@_query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(quality.with_score(docs, model), quality.PASS_SCORE)


@_query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.with_ids(docs, path, pattern, decoded="bytes").select(
        "doc_id",
        bpe_codec.n_ids().alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@_query
def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = token_store.write_store(docs, public_tokenizers.path(WORDS_FILE), end_id=2)
    read = token_store.read_store(spark, store)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: Pages have no time of their own; records carry this one.
WARC_DATE = "2024-01-01T00:00:00Z"


@_query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc_zst.write_pages(table(spark, sf_dir, "pages"), WARC_DATE)
    return warc_zst.read_warc(spark, folder).select(
        warc_zst.page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc_zst.page_of("refers_to").alias("refers_to"),
    )


ORACLES["op11_warc"] = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     k AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
     w AS (SELECT *, CASE WHEN n >= {warc_zst.REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY h, n) ELSE page_id END AS best FROM k)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN best IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best IS DISTINCT FROM page_id THEN best END AS refers_to
FROM w
"""

#: Clusters, rounds, dimensions and seed of op12.
CLUSTERS, ROUNDS, DIMENSIONS, SEED = 8, 10, 64, 3


@_query
def op12_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = pivot_clusters.clusters(table(spark, sf_dir, "embeddings"), CLUSTERS, ROUNDS, DIMENSIONS, SEED)
    return pivot_clusters.with_inertia(found, centroids)


def _clusters_sql() -> str:
    """One pair of CTEs per round: nearest centroid by vector, centroids after it."""
    finite = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: "
        f"CAST(floor({pivot_clusters.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings "
        f"WHERE len(embedding) = {DIMENSIONS} AND {finite})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS k, x FROM v "
        f"QUALIFY k < {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"d{r} AS MATERIALIZED (SELECT rid, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, c{r}.x), "
            f"lambda z: (z[1] - z[2]) * (z[1] - z[2]))), k := k)) AS m FROM v, c{r} GROUP BY rid)"
        )
        if r < ROUNDS:
            steps.append(
                f"s{r} AS (SELECT k, list(m2 ORDER BY i) AS x FROM (SELECT m.k AS k, i, CAST(floor(sum(y)::DECIMAL(38,0) / count(*)) AS BIGINT) AS m2 "
                f"FROM (SELECT rid, unnest(x) AS y, unnest(range({DIMENSIONS})) AS i FROM v) JOIN d{r} USING (rid) GROUP BY m.k, i) GROUP BY k)"
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(s{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN s{r} USING (k))")
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance,
       CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM d{ROUNDS} JOIN v USING (rid) JOIN c{ROUNDS} c ON c.k = m.k"""
    )


ORACLES["op12_pivot_clusters"] = _clusters_sql()


def _with_repeats(docs: DataFrame) -> DataFrame:
    """The input of op13 (doc_id, text): in every tenth document by its id's crc32 the
    words from a place on become repeats of the words that stand there first."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, found).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    p = F.expr("int(1 + (n - a) div (3 + g % 8))")
    sized = rows.withColumn("p", p).withColumn("times", F.expr("int((n - a) div p + 1)"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.col("times"))), F.lit(1), F.col("n") - F.col("a"))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return sized.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs)
    ranked = F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("top", F.array_max(ranked)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.expr("1000 * top.length div -top.p").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
