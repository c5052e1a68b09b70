import random
import re

import numpy as np
import pytest
import xxhash

from bitext.llm import simhash as sh


def _brute_fp(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def _roots(fps, radius=4):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_fingerprints():
    for t in (None, "", "one", "A b c", "The cat\tsat on\nthe Mat é É", "x " * 500, "  y"):
        assert sh.fingerprint((t or "").encode()) == _brute_fp(t)


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    rnd = random.Random(radius)
    for seed in (1, 2):
        masks = sh.cover_masks(radius, seed)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(5000):
            diff = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, radius)))
            assert any(not m & diff for m in masks)


@pytest.mark.parametrize("split", [10_000, 3])
def test_links_connect_all_near_points(spark, monkeypatch, split):
    monkeypatch.setattr(sh, "SPLIT", split)
    monkeypatch.setattr(sh, "_BLOCK", 16)
    rnd = random.Random(7)
    fps = []
    for _ in range(12):
        at = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 14)):  # chains that drift
            fps.append(at)
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                at ^= 1 << b
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = sh.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    found = {r.node: r.root for r in sh.components(edges).collect()}
    mine = [found.get(f, f) for f in signed]
    exp = _roots(fps)
    for i in range(len(fps)):
        for j in range(i):
            assert (mine[i] == mine[j]) == (exp[i] == exp[j])


def _docs():
    rnd = random.Random(9)
    base = [" ".join(f"w{rnd.randrange(400)}" for _ in range(300)) for _ in range(8)]
    rows = []
    for i in range(60):
        words = rnd.choice(base).split()
        if rnd.random() < 0.5:
            words[rnd.randrange(300)] = "changed"
        rows.append((i + 10, " ".join(words)))
    return rows + [(3, None), (4, ""), (5, " \n"), (None, base[0]), (None, "alone here now"), (10, rows[0][1]), (6, "x")]


def test_components_of_documents(spark):
    rows = _docs()
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in sh.near_dups(df).collect())
    fps = [_brute_fp(t) for _, t in rows]
    root = _roots(fps)
    least = {c: min((rows[i][0] for i in range(len(rows)) if root[i] == c and rows[i][0] is not None), default=None) for c in set(root)}
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    assert got == sorted((str(rows[i][0]), signed[i], str(least[root[i]])) for i in range(len(rows)))

    one = sh.one_of_each(df)
    assert one.columns == df.columns
    kept = one.collect()
    assert len(kept) == len(set(root))
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(x) for x in least.values())


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sh.near_dups(empty).count() == 0 and sh.one_of_each(empty).count() == 0


def test_hub_and_dense_bucket(spark, monkeypatch):
    """A node with 100,000 links, and many points that all collide twice."""
    from pyspark.sql import functions as F

    hub = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = sh.components(hub.union(spark.createDataFrame([(7_000_000, 7_000_001)], "a long, b long")))
    assert {(r.root, r["count"]) for r in got.groupBy("root").count().collect()} in ({(0, 100_000), (7_000_000, 1)}, {(0, 100_001), (7_000_000, 2)})
    monkeypatch.setattr(sh, "SPLIT", 16)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 3)
    points = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(1 << rng.integers(0, 62, (300, 3)), axis=1) for b in base]))
    df = spark.createDataFrame([(int(x),) for x in points], "fp long")
    found = {(r.a, r.b) for r in sh.links(df, 4).collect()}
    parent = {int(x): int(x) for x in points}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def grouped(links):
        for x in parent:
            parent[x] = x
        for a, b in links:
            parent[root(a)] = root(b)
        groups = {}
        for x in parent:
            groups.setdefault(root(x), set()).add(x)
        return {frozenset(g) for g in groups.values()}

    near = np.bitwise_count((points[:, None] ^ points[None, :]).astype(np.uint64)) <= 4
    assert grouped(found) == grouped((int(points[i]), int(points[j])) for i, j in zip(*np.nonzero(near)) if i < j)
