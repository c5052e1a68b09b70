import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from bitext.llm import periodic_runs as pr
from bitext.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _runs(words, least):
    """(start, length, period) by comparing the words with themselves, shifted by every period."""
    known = {}
    x = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    best = {}
    for q in range(1, len(x) // 2 + 1):
        step = np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(int), [0]]))
        for s, e in zip(np.flatnonzero(step == 1).tolist(), (np.flatnonzero(step == -1) + q).tolist()):
            if e - s >= max(least, 2 * q):
                best.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def _left(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _texts(rnd):
    for _ in range(30):
        n, letters = rnd.randrange(0, 120), "abcde"[: rnd.choice([1, 2, 2, 3, 5])]
        words = [rnd.choice(letters) for _ in range(n)]
        kind = rnd.randrange(5)
        if kind == 1:  # a repeated stretch between others
            base = [rnd.choice("abc") for _ in range(rnd.randrange(1, 20))]
            words = words[:15] + (base * 60)[: rnd.randrange(0, 100)] + words[15:30]
        elif kind == 2:  # Fibonacci word: as many runs as there can be
            x, y = ["a"], ["b"]
            for _ in range(rnd.randrange(3, 10)):
                x, y = x + y, x
            words = x[:150]
        elif kind == 3:  # a period that itself nearly has one: stretches touch
            inner = rnd.choice([["a", "b"], ["a", "a", "b"]])
            part = (inner * 20)[: rnd.randrange(2, 25)]
            words = ["b"] * rnd.randrange(2) + (part * 10)[: rnd.randrange(10, 120)] + ["b"] * rnd.randrange(2) + words[:10]
        yield words


@pytest.mark.parametrize("least", [2, 5, 12])
def test_equals_all_periods(least):
    rnd, found = random.Random(least), 0
    for _ in range(60):
        texts = list(_texts(rnd))
        runs, left = pr._searched([[w.encode() for w in t] for t in texts], least)
        for words, got, rest in zip(texts, runs, left):
            want = _runs(words, least)
            assert [(r["start"], r["length"], r["period"]) for r in got] == want
            assert rest.decode() == _left(words, want)
            found += len(want)
    assert found > 1000


def test_successor_and_ranks():
    rng = np.random.default_rng(1)
    for n in (1, 2, 64, 100, 1000):
        values = rng.permutation(n)
        lo = rng.integers(0, n, 200)
        hi = np.minimum(lo + rng.integers(1, n + 1, 200), n)
        least = rng.integers(0, n + 1, 200)
        got = pr.Wavelet(values).successor(lo, hi, least)
        assert got.tolist() == [min((v for v in values[a:b].tolist() if v >= x), default=n) for a, b, x in zip(lo, hi, least)]
        text = np.append(rng.integers(1, 3, n - 1), 0)
        line = text.tolist()
        factors = pr.Factors(text)
        assert factors.order.tolist() == sorted(range(n), key=lambda i: line[i:])


def test_edges_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(pr, "BLOCK_WORDS", 40)  # texts of a batch in several blocks
    rnd = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "x " * 5000), (4, "x " * 5000), (None, "a b " * 8), (5, "é ü " * 12)]
    rows += [(i, " ".join(w)) for i, w in enumerate(_texts(rnd), 10)]
    rows.append((99, "\x0b".join(rnd.choice("ab") for _ in range(30_000))))
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], "doc_id long, text string, runs int, collapsed string, start int")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in pr.periodic_runs(df).collect()]
    want = []
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if d == 99:  # too long to try all periods: the count of a text by itself, and the words left
            got_runs = [g for g in got if g[0] == 99][0][2]
            assert all(n >= max(12, 2 * q) and words[s : s + n - q] == words[s + q : s + n] for s, n, q in got_runs)
            short = [r for r in _runs(words[:3000], 12) if r[0] + r[1] < 3000]
            assert [r for r in got_runs if r[0] + r[1] < 3000] == short
            want.append((d, len(words), got_runs, _left(words, got_runs)))
            continue
        runs = _runs(words, 12)
        want.append((d, len(words), runs, _left(words, runs)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pr.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = _runs(words, 12)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((r.doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha(lines), sha(_left(words, runs))))
    assert sorted(map(tuple, QUERIES["op13_periodic_runs"](spark, SF).collect())) == sorted(want)
    assert any(w[1] for w in want)
