import re
import zlib

import numpy as np
import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as cp
from bitext.llm import bpe_codec, quality
from bitext.llm.common import held_out

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_stages_against_brute_force(spark):
    assert [n for n, _ in cp.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns = docs.columns
    outs = []
    for name, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, SF), "test")
        outs.append(docs)
        if name != "bpe":
            assert docs.columns == columns
    rows = [{r.doc_id: r.text for r in o.collect()} if "text" in o.columns else None for o in outs]

    everything = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    test = [d for d in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([(d in rows[0]) == bool(labels[d]) for d in test]) > 0.8
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    ids = list(everything)
    kept = {d for d, s in zip(ids, model.scores([everything[d] or "" for d in ids])) if s >= quality.PASS_SCORE}
    assert set(rows[0]) == kept

    best = {}
    for d, t in rows[0].items():
        best[_fold(t)] = max(d, best.get(_fold(t), d))
    assert set(rows[1]) == set(best.values())

    def fp(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", _fold(t))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    ids = sorted(rows[1])
    fps = [fp(rows[1][d]) for d in ids]
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert set(rows[2]) == {ids[g] for g in set(group)}

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(_fold(r.text))
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12) if w else 0)}
    clean = set()
    for d, t in rows[2].items():
        w, hit = word.findall(_fold(t)), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
        if not hit or 20 * len(hit) < len(w):
            clean.add(d)
    assert set(rows[3]) == clean

    tokens = bpe_codec.read_ranks(public_tokenizers.path(cp.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    last = outs[4].collect()
    assert {r.doc_id for r in last} == clean
    for r in last:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(rows[3][r.doc_id] or "")


def test_stages_take_odd_rows(spark):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word", None, "s", 4), (None, "word", "en", None, 4)]
    for rows in ([], odd):
        for name, stage in cp.STAGES:
            got = stage(spark, spark.createDataFrame(rows, COLUMNS), SF)
            assert got.count() <= len(rows), name


def test_held_out_is_crc32(spark):
    df = spark.range(2000).select(held_out(F.col("id")).alias("h"), "id")
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in df.collect())
