import duckdb
import pytest

import __spark_entry__ as E
from bitext.plans import QUERIES
from bitext.sources.tables import TABLES

from conftest import SF_SMALL

NO_SQL = {"bpe_vocabulary"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"row_id", "corpus", "src_words", "tgt_words", "ratio"}


def test_every_query_has_an_oracle_except_iterative():
    q, o = E.queries(), E.oracle_sql()
    assert set(QUERIES) - set(o) == NO_SQL
    assert set(o) <= set(q)


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.mark.parametrize(
    "name",
    ["clean_corpus", "ratio_filter", "stage_counts", "encode_ids", "bleu_sent_m4", "recipe_set3",
     "early_stop", "greedy_decode", "masked_loss", "grid_missing", "dict_report", "pretokenize", "split_absolute", "bpe_apply",
     "bleu_subword_m4", "decode_loop", "masked_loss_logits", "length_quantiles", "experiment_results", "shuffle_rows", "vocab_ws"],
)
def test_query_matches_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    exp = sorted(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert got == exp
