import hashlib
import random

import numpy as np

from bitext.llm import exact_dedup as ed
from bitext.llm.perfect_hash import PerfectHash, as_words

SCHEMA = "doc_id long, text string, digest string, kept int"


def _fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def _rows(n=300, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["Same Text", "same text", "ÄÖ x", "äö x", "", None, f"own {rnd.randint(0, 40)}"]), "d", 0) for i in range(n)]
    return rows + [(None, "same text", "d", 0), (None, "only null", "d", 0), (7, rows[7][1], "d", 0), (7, rows[7][1], "e", 1)]


def test_perfect_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 1000):
        keys = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        words = as_words(keys)
        made, slot = PerfectHash.build(words)
        assert sorted(slot.tolist()) == list(range(n))
        again = PerfectHash.load(*made.dump())
        assert np.array_equal(again.slots(words), slot)


def test_equals_grouping(spark, monkeypatch):
    monkeypatch.setattr(ed, "KEYS_PER_BUCKET", 8)  # several buckets
    rows = _rows()
    got = ed.exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(_fold(r[1]), []).append(r[0])
    by_digest = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[bytes(r.digest)]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)


def test_history_of_another_split(spark):
    rows = _rows(120, 2)
    digests = ed.digest_table(spark.createDataFrame(rows, SCHEMA))
    for history in (None, digests["doc_id"] % 2 == 0, digests["doc_id"] < -1, digests["doc_id"] >= 0):
        best = {bytes(r.digest): (r.doc_id, r.n) for r in ed.decisions(digests, history).collect()}
        groups = {}
        for r in rows:
            groups.setdefault(hashlib.sha256(_fold(r[1]).encode()).digest(), []).append(r[0])
        assert best == {d: (max((i for i in ids if i is not None), default=None), len(ids)) for d, ids in groups.items()}


def test_first_copies_keeps_columns_and_one_row_each(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key string, row_pick int")
    got = ed.first_copies(df)
    assert got.columns == df.columns
    kept = got.collect()
    assert sorted(_fold(r.text) for r in kept) == sorted({_fold(r[1]) for r in rows})


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ed.exact_dedup(empty).count() == 0
    assert ed.first_copies(empty).count() == 0
