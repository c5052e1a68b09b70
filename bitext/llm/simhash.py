"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints: 64 bits, bit b is set if it is set in more than half of the
XXH64 values of the text's word shingles.

Search: every bit position gets a vector of r+1 bits; table v (any nonzero
vector of r+1 bits) keeps the positions whose vector has an odd inner
product with v.  The vectors of the at most r positions in which a pair
differs span at most r dimensions, so some v is orthogonal to all of them and
that table's key is equal on both sides: no pair within the radius is missed.

Equal fingerprints are one point, so a group of copies is one row.  A bucket
with more than ``SPLIT`` points is cut again by a second, independent
family within the bucket (which covers too), so that a dense bucket is dealt
over many tasks; inside a final bucket points are compared in blocks and only
a spanning forest of its links goes on, never all pairs.  Components are
closed by alternating large-star and small-star rounds.

Edge cases: null, empty and wordless texts have fingerprint zero and link like
any other; rows with a null id take part, a component's id is its smallest
non-null id (null if there is none); repeated rows are kept; further columns
are not read."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitext.llm.common import byte_texts, fresh, parts, stored, text_of

BITS = 64
SEED = 42
SHINGLE = 4
RADIUS = 4
SPLIT = 4096
_BLOCK = 1024

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(_FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist())
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in range(BITS) if 2 * counts[b] > n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in parts(batches):
            fps = np.array([fingerprint(t, shingle) for t in byte_texts(batch.column(2))], "<u8")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps.view("<i8"))], names=["doc_id", "text_hash", "fp"]
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col)
    )
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def cover_masks(radius: int, seed: int) -> list[int]:
    """2^(radius+1)-1 masks; whatever ``radius`` bits differ, one mask has none of them."""
    rng = np.random.default_rng(seed)
    vectors = 1 + np.arange(BITS) % (2 ** (radius + 1) - 1)  # every nonzero vector about equally often
    rng.shuffle(vectors)
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        odd = [b for b in range(BITS) if (int(vectors[b]) & v).bit_count() % 2]
        masks.append(sum(1 << b for b in odd))
    return masks


def _keys(masks: list[int], fp: Column, *more: Column) -> Column:
    """One key per table, a hash of the table's number and the kept bits; a
    collision only adds candidates, which the bit distance then refuses."""
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m)), *more) for i, m in enumerate(signed)])


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect all points within the radius of each other."""
    n = len(fps)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for lo in range(0, n, _BLOCK):
        for lo2 in range(lo, n, _BLOCK):
            a, b = fps[lo : lo + _BLOCK], fps[lo2 : lo2 + _BLOCK]
            near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
            if lo == lo2:
                near = np.triu(near, 1)
            for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
                x, y = root(lo + i), root(lo2 + j)
                if x != y:
                    parent[x] = y
                    links.append((lo + i, lo2 + j))
    return links


def _bucket_links(points: DataFrame, radius: int) -> DataFrame:
    """points (key, fp), the rows of a key together: links inside each key."""

    def run(batches):
        key, held = None, []

        def close(fps):
            fps = np.concatenate(fps)
            return [(int(fps[i]), int(fps[j])) for i, j in _forest(fps.view("<u8"), radius)] if len(fps) > 1 else []

        out = []
        for batch in batches:
            keys, fps = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero(np.diff(keys)) + 1
            edges = [0, *cuts.tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if keys[a] != key and held:
                    if len(held) > 1 or len(held[0]) > 1:
                        out += close(held)
                    held = []
                key = keys[a]
                held.append(fps[a:b].copy())
            if out:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["a", "b"]), preserve_index=False)
                out = []
        if held:
            out = close(held)
        if out:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["a", "b"]), preserve_index=False)

    dealt = points.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct ``points`` (fp) -> (a, b) with a < b, enough links to connect
    all points within ``radius`` bits."""
    first, second = cover_masks(radius, 1), cover_masks(radius, 2)
    keyed = points.select(F.explode(_keys(first, F.col("fp"))).alias("key"), "fp")
    sizes = keyed.groupBy("key").count().filter(F.col("count") > 1)
    # sizes: counted with map-side combine; keys of one point drop out
    sized = stored(sizes, "bucket-sizes")
    small = sized.filter(F.col("count") <= SPLIT).select("key")
    large = sized.filter(F.col("count") > SPLIT).select("key")
    again = keyed.join(large, "key").select(F.explode(_keys(second, F.col("fp"), F.col("key"))).alias("key"), "fp")
    again = stored(again, "dense-points")
    # a bucket that is dense after both cuts: its points are dealt into blocks, and every
    # pair of blocks is a bucket of its own, so that tasks share the comparisons
    dense = again.groupBy("key").count().filter(F.col("count") > SPLIT)
    blocks = F.ceil(F.col("count") / SPLIT).cast("int")
    dealt = again.join(dense.select("key", blocks.alias("n")), "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    pairs = dealt.select("key", "fp", "own", other).select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp"
    )
    final = keyed.join(small, "key").unionByName(again.join(dense, "key", "left_anti")).unionByName(pairs)
    found = _bucket_links(final, radius)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, root) with root the least node of its component,
    by large-star and small-star rounds until nothing changes.

    A node's least neighbour is a grouped minimum (combined in the tasks) that is joined
    back to its links, so a hub's links are never gathered in one task: the join's other
    side has a row per node, and Spark splits a hub's links over tasks."""
    now = stored(edges.select("a", "b").filter("a <> b").distinct(), "links")
    state = None

    def with_least(links: DataFrame) -> DataFrame:
        return links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u")

    for _ in range(max_rounds):
        both = now.union(now.select("b", "a")).toDF("u", "v")
        large = with_least(both).filter("v > u").select("v", F.least("m", "u").alias("m"))
        # small star: each node hands its smaller neighbours the least of them
        down = large.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v").distinct()
        down = with_least(stored(down, "down"))
        small = down.select(F.explode(F.array("u", "v")).alias("v"), "m").filter("v <> m").distinct()
        now = stored(small.toDF("b", "a").select("a", "b"), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = seen
    raise RuntimeError("components did not settle")


def _grouped(
    docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with fingerprints, the root of each fingerprint, and of each root the
    first row: the least id (null last), then the least text hash."""
    marked = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    points = stored(marked.groupBy("fp").agg(F.min(first).alias("first")), "points")
    # the graph's nodes are fingerprints, not documents
    member = components(links(points.select("fp"), radius))
    rooted = points.join(member.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = stored(rooted.withColumn("root", F.coalesce("root", "fp")), "rooted")
    return marked, rooted.select("fp", "root"), rooted.groupBy("root").agg(F.min("first").alias("first"))


def near_dups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """doc_id, fp, component_id: one row per row of ``docs``."""
    marked, rooted, roots = _grouped(docs, id_col, text_col, shingle, radius)
    named = rooted.join(roots, "root").select("fp", F.col("first.doc_id").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """Of each component the first row (least id, then least text hash); of rows
    equal in id and text any one."""
    _, _, roots = _grouped(docs, id_col, text_col, shingle, radius)

    def name(doc_id: Column, text_hash: Column) -> Column:
        return F.concat_ws(":", doc_id.cast("long").cast("string"), text_hash.cast("string"))

    key, pick = fresh(docs, "row_key"), fresh(docs, "row_pick")
    keep = roots.select(name(F.col("first.doc_id"), F.col("first.text_hash")).alias(key)).distinct()
    hit = docs.withColumn(key, name(F.col(id_col), F.xxhash64(text_of(text_col)))).join(keep, key, "left_semi")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(key))
    return hit.withColumn(pick, nth).filter(F.col(pick) == 1).drop(key, pick)
