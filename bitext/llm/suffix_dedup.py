"""Suffix-array dedup: remove every byte that lies in a ``LENGTH``-byte string
which also starts somewhere else.

Shards are found so that equal strings always meet.  Every ``LENGTH``-byte
window names one anchor: the place of the least hash among its ``GRAM``-byte
substrings, a choice that depends on the window's bytes alone.  Neighbouring
windows share anchors, so an anchor owns a range of window starts and a context of
bytes.  A window can only repeat where the same gram is an anchor again:

* a context whose equal occurs twice is a repeat from end to end (found by
  counting, with map-side combine, so a passage in a third of all rows is a row
  per task); equal contexts in a row, as in a text of one character, are one row;
* of grams with several different contexts, the windows fall into ``CLASSES`` by
  where the anchor lies in them; all windows of a class share a stretch of bytes
  around the anchor, and a class whose stretch no other context has cannot hold a
  repeat and is left out;
* the rest is dealt into shards of about ``SHARD_BYTES``, one text per different
  context, and each shard's suffixes are sorted by external induced sorting
  (``induced_sort``); neighbours in the order with a common prefix of ``LENGTH``
  bytes are repeats;
* grams with more than ``HOT_CONTEXTS`` different contexts would be one unbounded
  shard; their windows are counted one by one instead, by a 128-bit hash.

Edge cases: null counts as empty; texts shorter than ``LENGTH`` stay whole; equal
texts, also repeated rows, are repeats of each other; null ids stay; an empty
table gives no rows; further columns are not read."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext.llm.common import byte_texts, parts, stored, text_of
from bitext.llm.induced_sort import Scratch, suffix_array

LENGTH = 400
GRAM = 128
CLASSES = 4
SHARD_BYTES = 2 << 20
HOT_CONTEXTS = 4_000

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_STARTS = 1 << 21  # window starts of one text worked on at once
_POSITION = (1 << 24) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 1 << 12), _powers(_BACK, 1 << 12)


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    global _UP, _DOWN
    n = len(text)
    if n >= len(_UP):
        _UP, _DOWN = _powers(_BASE, 2 * n), _powers(_BACK, 2 * n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _DOWN[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * _UP[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _same_contexts(part: np.ndarray, lo: np.ndarray, n: np.ndarray, off: np.ndarray, gram: np.ndarray, length: int) -> np.ndarray:
    """For each anchor the number of the first one of its row of equal contexts that follow
    each other without a gap, as a text with a period gives them by the thousand."""
    first = np.arange(len(lo))
    alike = (n[1:] == n[:-1]) & (off[1:] == off[:-1]) & (gram[1:] == gram[:-1])
    if not alike.any():
        return first
    edges = np.flatnonzero(np.diff(np.concatenate([[0], alike.astype(np.int8), [0]])))
    for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):  # anchors i to j are alike
        step = int(n[i])
        a, z = int(lo[i]), int(lo[j] + n[j]) + length - 1
        # equal bytes one step apart, over a whole context: the next context is the same
        differ = np.flatnonzero(part[a : z - step] != part[a + step : z])
        upto = np.searchsorted(differ, (lo[i:j] - a) + step + length - 1) - np.searchsorted(differ, lo[i:j] - a)
        same = np.concatenate([[False], upto == 0])
        own = np.arange(i, j + 1)
        first[i : j + 1] = np.maximum.accumulate(np.where(same, i, own))
    return first


def anchors(text: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """(lo, n_starts, offset of the anchor, gram hash, context hash, times) that together
    own every window start of the text once; ``times`` equal contexts follow each other,
    ``n_starts`` apart."""
    raw, out = np.frombuffer(text, np.uint8), []
    width = length - GRAM + 1
    for base in range(0, len(raw) - length + 1, _STARTS):
        part = raw[base : base + _STARTS + length - 1]
        hashes = _gram_hashes(part)
        n = len(hashes)
        # the leftmost least hash of each window: minima from both ends of blocks
        key = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
        key[:n] = (hashes & ~np.uint64(_POSITION)) | np.arange(n, dtype=np.uint64)
        blocks = key.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n_starts = n - width + 1
        least = np.minimum(behind[:n_starts], ahead[width - 1 : width - 1 + n_starts])
        at = (least & np.uint64(_POSITION)).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        past = np.append(lo[1:], n_starts)
        place = at[lo]
        grams = hashes[place].view(np.int64)
        first = _same_contexts(part, lo, past - lo, place - lo, grams, length)
        head = np.flatnonzero(first == np.arange(len(lo)))
        times = np.diff(np.append(head, len(lo)))
        columns = (lo[head], past[head], place[head], grams[head], times)
        for a, b, p, g, k in zip(*(c.tolist() for c in columns)):
            context = xxhash.xxh3_64_intdigest(part[a : b + length - 1])
            out.append((base + a, b - a, p - a, g, context - (1 << 63), k))
    return out


def repeated_starts(contexts: list[bytes], n_starts: list[int], length: int, scratch: Scratch) -> list[np.ndarray]:
    """For each context, which of its first ``n_starts`` windows equal another
    window of the shard, from the sorted suffixes."""
    m = len(contexts)
    sizes = np.fromiter(map(len, contexts), np.int64, m)
    total = int(sizes.sum()) + m
    text, owned = scratch.array(total), scratch.array(total, np.bool_)
    raw = scratch.array(total + 8, np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    for i, (c, n) in enumerate(zip(contexts, n_starts)):
        a = begin[i]
        raw[a : a + len(c)] = np.frombuffer(c, np.uint8)
        text[a : a + len(c)] = raw[a : a + len(c)]
        text[a : a + len(c)] += m
        text[a + len(c)] = m - 1 - i  # ends differ, so no common prefix passes one
        owned[a : a + n] = True
    order = suffix_array(text, m + 256, scratch)
    order = order[owned[order]]
    # common prefixes of neighbours, eight bytes at a time; windows end before their context does
    words = np.zeros(total, np.uint64)
    for k in range(8):
        words |= raw[k : k + total].astype(np.uint64) << np.uint64(8 * k)
    a, b = order[:-1], order[1:]
    rows = np.arange(len(a))
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    for d in steps:
        rows = rows[words[a[rows] + d] == words[b[rows] + d]]
    hit = np.zeros(total, bool)
    hit[a[rows]] = hit[b[rows]] = True
    return [np.flatnonzero(hit[begin[i] : begin[i] + n]) for i, n in enumerate(n_starts)]


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """Ascending numbers as (first, past) runs."""
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(at, cuts)]


_SPAN = "t1 long, t2 long, first long, past long"


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["t1", "t2", "first", "past"])


def class_bounds(length: int) -> list[tuple[int, int]]:
    """Distances from a window's start to its anchor, in ``CLASSES`` ranges."""
    places = length - GRAM + 1
    edges = [places * c // CLASSES for c in range(CLASSES + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]


def live_starts(n: int, off: int, classes: list[int], bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, past) runs of the window starts that lie in the classes."""
    spans = sorted((max(0, off - high), min(n, off - low + 1)) for low, high in (bounds[c] for c in classes))
    out: list[list[int]] = []
    for first, past in spans:
        if out and first <= out[-1][1]:
            out[-1][1] = max(past, out[-1][1])
        elif first < past:
            out.append([first, past])
    return [(a, b) for a, b in out]


def _sort_shards(length: int):
    bounds = class_bounds(length)

    def run(batches):
        shard, keys, contexts, starts = None, [], [], []

        def close():
            scratch = Scratch()
            try:
                found = repeated_starts(contexts, starts, length, scratch)
                return _spans(
                    [(t1, t2, lo + a, lo + b - 1 + length) for (t1, t2, lo), hit in zip(keys, found) for a, b in _runs(hit)]
                )
            finally:
                scratch.close()

        for b in parts(batches):
            for s, t1, t2, lo, n, off, context, classes in zip(*(c.to_pylist() for c in b.columns)):
                if s != shard and contexts:
                    yield close()
                    keys, contexts, starts = [], [], []
                shard = s
                for first, past in live_starts(n, off, classes, bounds):
                    keys.append((t1, t2, lo + first))
                    contexts.append(context[first : past + length - 1])
                    starts.append(past - first)
        if contexts:
            yield close()

    return run


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(t1, t2, first, past): byte spans to remove, by the text's key."""
    keys = [F.xxhash64(text_of(text_col)).alias("t1"), F.xxhash64(F.lit(1), text_of(text_col)).alias("t2")]
    texts = docs.select(*keys, text_of(text_col).alias("text")).filter(F.octet_length("text") >= length)

    def find(batches):
        names = ["t1", "t2", "lo", "n", "off", "gram", "context", "times"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for part in parts(batches, 200):
            t1, t2 = part.column(0).to_pylist(), part.column(1).to_pylist()
            rows = [(x, y, *r) for x, y, t in zip(t1, t2, byte_texts(part.column(2))) for r in anchors(t, length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    found = texts.mapInArrow(find, "t1 long, t2 long, lo long, n int, off int, gram long, context long, times long")
    found = stored(found, "anchors")
    same = ["gram", "context", "off", "n"]
    different = found.groupBy(*same).agg(F.sum("times").alias("copies"), F.min(F.struct("t1", "t2", "lo")).alias("at"))
    different = stored(different, "contexts")

    # equal contexts: repeats from end to end
    twice = different.filter("copies > 1").select(*same)
    whole = found.join(twice, same).select("t1", "t2", F.col("lo").alias("first"), (F.col("lo") + F.col("n") * F.col("times") + (length - 1)).alias("past"))

    # grams with several contexts: their bytes, one row per different context
    grams = different.groupBy("gram").agg(F.count("*").alias("n_contexts")).filter("n_contexts > 1")
    mixed = stored(different.join(grams, "gram").select("gram", "n_contexts", "n", "off", "at.*"), "mixed")
    wanted = mixed.groupBy("t1", "t2").agg(F.collect_list(F.struct("gram", "n_contexts", "lo", "n", "off")).alias("wanted"))

    def cut(batches):
        names = ["t1", "t2", "gram", "n_contexts", "lo", "n", "off", "bytes"]
        kinds = [*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.binary()]
        for part in parts(batches, 100):
            t1, t2, wanted = (part.column(i).to_pylist() for i in (0, 1, 3))
            rows = [
                (x, y, *(w[k] for k in names[2:7]), t[w["lo"] : w["lo"] + w["n"] + length - 1])
                for x, y, t, ws in zip(t1, t2, byte_texts(part.column(2)), wanted)
                for w in ws
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    pieces = texts.join(wanted, ["t1", "t2"]).mapInArrow(
        cut, "t1 long, t2 long, gram long, n_contexts long, lo long, n int, off int, bytes binary"
    )
    pieces = stored(pieces.dropDuplicates(["t1", "t2", "lo"]), "pieces")

    # classes of window starts whose common stretch another context has too
    bounds = class_bounds(length)
    stretches = [
        F.when(
            (F.col("off") >= low) & (F.col("off") - high < F.col("n")),
            F.xxhash64("gram", F.lit(c), F.substr("bytes", F.col("off") - low + 1, F.lit(length - (high - low)))),
        )
        for c, (low, high) in enumerate(bounds)
    ]
    classes = pieces.select("t1", "t2", "lo", F.posexplode(F.array(*stretches)).alias("class", "stretch")).filter("stretch is not null")
    shared = classes.groupBy("stretch").agg(F.count("*").alias("k")).filter("k > 1").select("stretch")
    alive = classes.join(shared, "stretch").groupBy("t1", "t2", "lo").agg(F.collect_set("class").alias("classes"))
    alive = stored(pieces.join(alive, ["t1", "t2", "lo"]), "candidates")

    # into shards, or start by start
    size = alive.filter(F.col("n_contexts") <= HOT_CONTEXTS).agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    n_shards = max(1, -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("gram"), F.lit(n_shards)).alias("shard")
    dealt = alive.filter(F.col("n_contexts") <= HOT_CONTEXTS).select(shard, "t1", "t2", "lo", "n", "off", "bytes", "classes")
    dealt = dealt.repartition(n_shards, "shard").sortWithinPartitions("shard", "t1", "t2", "lo")
    by_order = dealt.mapInArrow(_sort_shards(length), _SPAN)

    def one_by_one(batches):
        for b in parts(batches, 200):
            rows = []
            for t1, t2, lo, n, off, context, classes in zip(*(c.to_pylist() for c in b.columns)):
                for first, past in live_starts(n, off, classes, bounds):
                    rows += [(t1, t2, lo + i, xxhash.xxh3_128_digest(context[i : i + length])) for i in range(first, past)]
            if rows:
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["t1", "t2", "first", "window"],
                )

    hot = alive.filter(F.col("n_contexts") > HOT_CONTEXTS).select("t1", "t2", "lo", "n", "off", "bytes", "classes")
    hot = hot.mapInArrow(one_by_one, "t1 long, t2 long, first long, window binary")
    hot_twice = hot.groupBy("window").count().filter("count > 1").select("window")
    by_window = hot.join(hot_twice, "window").select("t1", "t2", "first", (F.col("first") + length).alias("past"))
    return whole.unionByName(by_order).unionByName(by_window).distinct()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, removed (merged spans), kept (the bytes left)."""
    spans = stored(repeated_spans(docs, text_col, length), "spans")
    by_text = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "past")).alias("spans"))
    rows = docs.select(
        F.xxhash64(text_of(text_col)).alias("t1"),
        F.xxhash64(F.lit(1), text_of(text_col)).alias("t2"),
        F.col(id_col).cast("long").alias("doc_id"),
        text_of(text_col).alias("text"),
    )
    joined = rows.join(by_text, ["t1", "t2"], "left").select("doc_id", "text", "spans")
    pair = pa.struct([("first", pa.int64()), ("past", pa.int64())])

    def cut(batches):
        for part in parts(batches):
            texts, removed, kept = byte_texts(part.column(1)), [], []
            for t, spans in zip(texts, part.column(2).to_pylist()):
                merged: list[list[int]] = []
                for first, past in sorted((s["first"], s["past"]) for s in spans or ()):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(past, merged[-1][1])
                    else:
                        merged.append([first, past])
                edges = [0, *(x for m in merged for x in m), len(t)]
                removed.append([{"first": a, "past": z} for a, z in merged])
                kept.append(b"".join(t[a:z] for a, z in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.list_(pair)),
                 pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "removed", "kept"],
            )

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<first:bigint,past:bigint>>, kept binary")
