import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from bitext.llm import induced_sort, suffix_dedup as sd


@pytest.mark.parametrize("in_memory", [1 << 20, 64])
def test_suffix_order(in_memory):
    rng = np.random.default_rng(3)
    for _ in range(300):
        symbols = int(rng.integers(1, 5))
        text = np.append(rng.integers(1, symbols + 1, rng.integers(0, 70)), 0).astype(np.int64)
        scratch = induced_sort.Scratch(in_memory)
        got = induced_sort.suffix_array(text, symbols + 1, scratch).tolist()
        scratch.close()
        line = text.tolist()
        assert got == sorted(range(len(line)), key=lambda i: line[i:])


def test_repeats_need_recursion():
    text = np.append(np.tile(np.random.default_rng(1).integers(1, 9, 37), 60), 0).astype(np.int64)
    line = text.tolist()
    got = induced_sort.suffix_array(text, 9, induced_sort.Scratch()).tolist()
    assert got == sorted(range(len(line)), key=lambda i: line[i:])


def _brute(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def _rows(seed):
    rnd = random.Random(seed)
    line = lambda n: " ".join(rnd.choice(["ab", "été", "c", "dd", "of"]) + str(rnd.randrange(50)) for _ in range(n))
    passages = [line(rnd.choice([60, 90, 130, 200])) for _ in range(5)]
    rows = []
    for i in range(50):
        rows.append((i, " ".join(rnd.choice([line(40), rnd.choice(passages)]) for _ in range(rnd.randint(0, 6)))))
    whole = line(300)
    rows += [(100, whole), (101, whole), (101, whole), (102, whole[:500] + "#" + whole[500:]), (None, whole[3:])]
    rows += [(110, "ab" * 900), (111, "q" + "abc" * 400 + "z" + "abc" * 400), (112, "abcd " * 90 + "e" + "abcd " * 90)]
    rows += [(103, None), (104, ""), (105, "x" * 399), (106, "x" * 400), (107, "y" * 401), (108, "z" * 5000), (109, passages[0][:399])]
    return rows


@pytest.mark.parametrize("hot,shard", [(20_000, 8 << 20), (20_000, 2000), (2, 8 << 20)])
def test_equals_brute_force(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(sd, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(sd, "SHARD_BYTES", shard)
    monkeypatch.setattr(sd, "_STARTS", 700)  # long texts in several parts
    rows = _rows(hot + shard)
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, n int, gram string")
    got = sd.remove_repeats(df).collect()
    found = [(r.doc_id, r.n_bytes, sum(s.past - s.first for s in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(found, key=str) == _brute(rows, sd.LENGTH)


def test_empty(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = sd.remove_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert (one.n_bytes, one.removed, bytes(one.kept)) == (0, [], b"")


def test_periodic_text_has_few_anchors():
    for piece in ("x", "ab", "abc def ", "".join(map(chr, range(32, 126)))):
        text = (piece * (2_000_000 // len(piece))).encode()
        found = sd.anchors(text)
        assert len(found) < 500
        assert sum(n * k for _, n, _, _, _, k in found) == len(text) - sd.LENGTH + 1
    rnd = random.Random(4)
    text = "".join(rnd.choice(["ab" * 300, "abc" * 200, "q", "long piece of text " * 30]) for _ in range(60)).encode()
    at = 0
    for lo, n, off, _, context, k in sd.anchors(text):
        assert lo == at
        at += n * k
        for i in range(k):
            a = lo + i * n
            assert sd.xxhash.xxh3_64_intdigest(text[a : a + n + sd.LENGTH - 1]) - (1 << 63) == context
    assert at == len(text) - sd.LENGTH + 1
