import hashlib
import math
import random

import numpy as np
import pytest

from bitext.llm import pivot_clusters as pc


def _brute(rows, k, rounds, dims, seed):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], cents


def _rows(seed, dims, n):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [c + rnd.gauss(0, 0.2) for c in rnd.choice(centres)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(n // 2)]  # one vector, many rows
    rows += [(5, rows[5][1]), (None, rows[7][1])]
    rows += [(2000, None), (2001, []), (2002, [0.0] * (dims - 1)), (2003, [float("nan")] + [0.0] * (dims - 1))]
    rows += [(2004, [float("-inf")] + [0.0] * (dims - 1)), (2005, [None] + [0.0] * (dims - 1))]
    return [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("dims,k,rounds", [(4, 5, 6), (16, 8, 10), (2, 3, 0)])
def test_equals_brute_force(spark, monkeypatch, dims, k, rounds):
    monkeypatch.setattr(pc, "SLICE", 37)
    monkeypatch.setattr(pc, "PIVOTS", 4)
    rows = _rows(dims, dims, 150)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, cluster int, v string").repartition(4)
    found, cents = pc.clusters(df, k, rounds, dims)
    want, want_cents = _brute(rows, k, rounds, dims, 3)
    assert cents.tolist() == want_cents
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    full = pc.with_inertia(found, cents).collect()
    assert {r.inertia for r in full} == {sum(d for _, _, d in want)}
    for r in full:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_cents[r.cluster])).encode()).hexdigest()


def test_bounds_leave_out_distances_and_no_nearest():
    rng = np.random.default_rng(2)
    centres = rng.integers(-5000, 5000, (8, 6))
    v = centres[rng.integers(0, 8, 4000)] + rng.integers(-60, 60, (4000, 6))
    v[:50] = v[0]
    pivots = v[pc.pick_pivots(v[:300], 6)]
    cluster, distance, exact = pc.nearest(v, pc._distances(v, pivots), centres, pc._distances(centres, pivots))
    all_d = ((v[:, None] - centres[None]) ** 2).sum(2)
    assert (cluster == all_d.argmin(1)).all() and (distance == all_d.min(1)).all()
    assert exact < 0.4 * all_d.size  # most centroids are ruled out by the pivots


def test_ties_go_to_the_smaller_number(spark):
    df = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate([0, 2, 1, 1])], "vec_id long, embedding array<double>")
    found, cents = pc.clusters(df, 4, 0, 1)
    # equal vectors 2 and 3 are two centroids; every vector goes to the first at its place
    assert {r.vec_id: r.cluster for r in found.collect()} == {r[0]: r[1] for r in _brute([(i, [float(x)]) for i, x in enumerate([0, 2, 1, 1])], 4, 0, 1, 3)[0]}


def test_few_empty_and_huge(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found, cents = pc.clusters(none)
    assert pc.with_inertia(found, cents).count() == 0 and len(cents) == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    found, cents = pc.clusters(two, 8, 3, 2)
    assert len(cents) == 2 and {r.distance for r in found.collect()} == {0}
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        pc.clusters(huge, 2, 1, 2)
