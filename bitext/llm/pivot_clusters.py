"""Centroid clustering of integer vectors with a LAESA pivot table.

Every vector's distances to a few fixed pivots are computed once and stored beside
it.  In each round the centroids' distances to the pivots (clusters x pivots
numbers, from the driver) give, for every vector and centroid, the lower bound
max over pivots of |d(vector, pivot) - d(centroid, pivot)|.  A vector meets the
centroid of the least bound first; only centroids whose bound does not exceed the
best distance so far receive their exact squared distance, in integers.

A round is one pass over the stored table: tasks add up their vectors per cluster
and send one row per cluster, Spark adds these up, and the driver gets clusters x
dimensions sums.  Nothing is shuffled by vector or cluster, so a vector that a third
of all rows share costs no more than any other.

The pivots come from the ``PIVOT_SAMPLE`` kept vectors that are first by a hash of the
id: the next pivot is the one farthest from those taken (ties: the earlier).  Pivots
decide only how many distances are left out, never the result.

Integers: a component x becomes floor(scale * x).  Components beyond 2^26 in size after
that raise an error, as squared distances might not fit into 64 bits.

Edge cases: a null vector, one of another length or with a null, NaN or infinite
component is left out; a null id stays (its hash sorts last for the start); repeated
rows each count and get their row; ties go to the smaller cluster number; with fewer
vectors than clusters there are as many clusters as vectors; an empty table gives no
rows; columns other than id and vector are not read, whatever their names."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitext.llm.common import stored

SCALE = 1024
PIVOTS = 12
PIVOT_SAMPLE = 512
LIMIT = 1 << 26
SLICE = 4096  # vectors worked on at once
_SLACK = 1e-6  # relative rounding of the bounds, far above a double's


def kept_vectors(vectors: DataFrame, dimensions: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<bigint>) of the vectors that are whole and finite."""
    x = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.size("x") == dimensions)
    # compared as doubles: NaN is greater than every number in Spark, so it fails here, too
    finite = F.forall("x", lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    whole = F.transform("x", lambda c: F.floor(c.cast("double") * SCALE))
    return rows.filter(finite).select("vec_id", whole.alias("v"))


def start_order(seed: int | str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    out = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    if out.size and max(int(out.max()), -int(out.min())) > LIMIT:
        raise ValueError(f"a vector's component is beyond {LIMIT} after scaling")
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows (int64)."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def pick_pivots(rows: np.ndarray, n: int) -> np.ndarray:
    """Row numbers: the first row, then always the one farthest from those taken."""
    taken, least = [0], squared(rows, rows[:1]).astype(float)
    while len(taken) < min(n, len(rows)) and least.max() > 0:
        taken.append(int(least.argmax()))
        least = np.minimum(least, squared(rows, rows[taken[-1] : taken[-1] + 1]))
    return np.array(taken)


def nearest(v: np.ndarray, pivot_distances: np.ndarray, centroids: np.ndarray, centroid_distances: np.ndarray):
    """(cluster, squared distance, number of exact distances) for the rows of ``v``."""
    n, k = len(v), len(centroids)
    bound = np.zeros((n, k))
    for p in range(pivot_distances.shape[1]):
        np.maximum(bound, np.abs(pivot_distances[:, p, None] - centroid_distances[:, p]), out=bound)
    # a little less, so that rounding never leaves out a nearest centroid
    bound = np.maximum(bound * (1 - _SLACK) - _SLACK * (1 + pivot_distances.max(axis=1, initial=0))[:, None], 0) ** 2
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(n, np.iinfo(np.int64).max)
    cluster = np.full(n, k)
    left, exact = np.arange(n), 0
    for turn in range(k):
        which = order[left, turn]
        may = bound[left, which] <= best[left]
        left, which = left[may], which[may]  # the bounds ascend: the others are done
        if not len(left):
            break
        d = squared(v[left], centroids[which])
        exact += len(left)
        better = (d < best[left]) | ((d == best[left]) & (which < cluster[left]))
        best[left[better]], cluster[left[better]] = d[better], which[better]
    return cluster, best, exact


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b, as doubles."""
    return np.sqrt(np.stack([squared(a, b[i : i + 1]) for i in range(len(b))], axis=1).astype(float))


_TABLE = "vec_id long, v array<bigint>, pivots array<double>"


def pivot_table(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds every vector's distances to the pivots."""
    shared = kept.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                v = _matrix(part.column(1), pivots.shape[1])
                near = _distances(v, shared.value)
                offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(pivots))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(near.ravel()))],
                    names=["vec_id", "v", "pivots"],
                )

    return kept.mapInArrow(run, _TABLE)


def _assigned(batches, state):
    """(part, its vectors, clusters, distances) of the table's batches."""
    centroids, near = state.value
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            v = _matrix(part.column(1), centroids.shape[1])
            pivots = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
            cluster, distance, _ = nearest(v, pivots, centroids, near)
            yield part, v, cluster, distance


def _sums(table: DataFrame, state, k: int, dimensions: int) -> list:
    """Rows (cluster, place, n, s): how many vectors, the exact sum of a component."""

    def run(batches):
        total, count = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)

        def row():
            some = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
                names=["cluster", "n", "sums"],
            )

        for _, v, cluster, _ in _assigned(batches, state):
            for c in np.unique(cluster):
                mine = v[cluster == c]
                total[c] += mine.sum(axis=0)
                count[c] += len(mine)
            if count.sum() > 1 << 34:  # well before a sum could pass 64 bits
                yield row()
                total[:], count[:] = 0, 0
        yield row()

    exact = T.DecimalType(38, 0)
    per_task = table.mapInArrow(run, "cluster int, n long, sums array<bigint>")
    places = per_task.select("cluster", "n", F.posexplode("sums").alias("place", "s"))
    return places.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(exact)).alias("s")).collect()


def clusters(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, seed: int | str = 3,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) for every kept vector and the centroids.

    The start is the ``k`` kept vectors with the least sha256 of ``seed:vec_id``, in
    that order.  ``rounds`` times every vector goes to the nearest centroid and every
    non-empty centroid becomes floor(sum / count) of its vectors; then vectors are
    assigned once more.  Rounds after one that moved nothing would change nothing
    and are left out."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dimensions, id_col, vector_col)
    first = [F.asc_nulls_last("h"), F.asc("v")]
    start = kept.withColumn("h", start_order(seed)).orderBy(*first).limit(max(k, PIVOT_SAMPLE)).select("v").collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dimensions), np.int64)
    rows = np.array([r.v for r in start], np.int64)
    centroids = rows[:k].copy()
    pivots = rows[pick_pivots(rows, PIVOTS)]
    table = stored(pivot_table(kept, pivots), "pivots")

    def state():
        return spark.sparkContext.broadcast((centroids, _distances(centroids, pivots)))

    for _ in range(rounds):
        shared = state()
        old = centroids.copy()
        for r in _sums(table, shared, len(centroids), dimensions):
            centroids[r.cluster, r.place] = int(r.s) // r.n
        shared.destroy()
        if (old == centroids).all():
            break
    shared = state()

    def run(batches):
        for part, _, cluster, distance in _assigned(batches, shared):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"]
            )

    return table.mapInArrow(run, "vec_id long, cluster int, distance long"), centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256: one row per cluster, joined."""
    spark = found.sparkSession
    found = stored(found, "clusters")
    exact = T.DecimalType(38, 0)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast(exact)).alias("s")).collect()}
    facts = [(c, sums.get(c, 0), sum(sums.values()), centroid_digest(x)) for c, x in enumerate(centroids)]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
