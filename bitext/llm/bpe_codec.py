"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

All pieces to be merged lie in one array of byte symbols, linked left and
right, with no link across pieces.  A bucket per merge rank holds the
positions whose pair has that rank; three levels of 64-bit words say which
buckets have entries, so the next rank is found by three find-first-set
steps, whatever the length of the pieces.  Entries are not removed when a
neighbour changes; an entry whose position no longer carries its rank is
stale and skipped when its bucket is opened.

A bucket is emptied from left to right, at once where that is the order the
one-at-a-time rule gives: when no merge of this rank can create a pair of a
lower rank (known for each rank from the vocabulary).  For the other ranks a
position goes first and the queue is asked again.

Texts are cut by the pattern first; distinct pieces are merged once and
remembered by the worker, up to ``CACHE`` pieces.  As a piece never reaches
from a character into white space after it, a text whose spaces stand singly
between other characters is cut at them first, and the ids of a word with its
space are remembered too;
``by_space=False`` is for patterns without that property.

Edge cases: null counts as empty and has no ids; a text of any length is one
row; texts without a match of the pattern have no ids; further columns pass
through; repeated rows stay."""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitext.llm.common import parts, replacing

CACHE = 100_000
CHUNK_CHARS = 2_000_000
_WIDE = 12  # positions from which a bucket is emptied by array operations


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def unicode_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode's property has it."""
    space = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
    return regex.compile(space.replace(r"\S", r"\P{White_Space}"))


class RankBits:
    """Which of n buckets have entries: words of 64 bits, three levels."""

    def __init__(self, n: int):
        a = -(-n // 64)
        b = -(-a // 64)
        self.low, self.mid, self.top = [0] * a, [0] * b, [0] * (-(-b // 64))

    def set(self, r: int) -> None:
        a = r >> 6
        self.low[a] |= 1 << (r & 63)
        self.mid[a >> 6] |= 1 << (a & 63)
        self.top[a >> 12] |= 1 << (a >> 6 & 63)

    def clear(self, r: int) -> None:
        a = r >> 6
        self.low[a] &= ~(1 << (r & 63))
        if not self.low[a]:
            self.mid[a >> 6] &= ~(1 << (a & 63))
            if not self.mid[a >> 6]:
                self.top[a >> 12] &= ~(1 << (a >> 6 & 63))

    def first(self) -> int:
        for i, w in enumerate(self.top):
            if w:
                m = (i << 6) + (w & -w).bit_length() - 1
                w = self.mid[m]
                a = (m << 6) + (w & -w).bit_length() - 1
                w = self.low[a]
                return (a << 6) + (w & -w).bit_length() - 1
        return -1


class BytePairs:
    """Pair ranks of a vocabulary and the merges over them."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        n = len(tokens)
        self.pair: dict[int, int] = {}
        unsafe = set()
        for r, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    self.pair[a * n + b] = r
                    unsafe.update(x for x in (a, b) if x > r and len(tokens[x]) > 1)
        self.unsafe = unsafe
        keys = np.fromiter(self.pair, np.int64, len(self.pair))
        order = np.argsort(keys)
        self._keys = keys[order]
        self._ranks = np.fromiter(self.pair.values(), np.int64, len(keys))[order]

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        want = a * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self._keys, want), len(self._keys) - 1)
        return np.where(self._keys[at] == want, self._ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        if not pieces:
            return []
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        if not n:
            return [b"" for _ in pieces]
        ids = self.byte[raw]
        ends = np.cumsum(sizes)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = ends[sizes > 0] - 1
        right[last] = -1
        left[(ends - sizes)[sizes > 0]] = -1
        have = np.full(n, -1, np.int64)  # the rank of the pair that starts here
        inner = np.flatnonzero(right >= 0)
        have[inner] = self._pair_ranks(ids[inner], ids[right[inner]])
        self._run(ids, left, right, have, np.repeat(np.arange(len(pieces)), sizes))
        alive = ids >= 0
        flat = ids[alive].astype("<u4").tobytes()
        upto = (4 * np.concatenate([[0], np.cumsum(alive)])[ends]).tolist()
        return [flat[a:b] for a, b in zip([0, *upto], upto)]

    def _run(self, ids, left, right, have, piece) -> None:
        bits = RankBits(len(self.tokens))
        buckets: dict[int, list] = {}

        def push(at: np.ndarray) -> None:
            ranks = have[at]
            keep = ranks >= 0
            at, ranks = at[keep], ranks[keep]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            starts = [0, *cuts.tolist()] if len(at) else []
            for i, j in zip(starts, [*starts[1:], len(at)]):
                r = int(ranks[i])
                if r in buckets:
                    buckets[r].append(at[i:j])
                else:
                    buckets[r] = [at[i:j]]
                    bits.set(r)

        def push_one(p: int, r: int) -> None:
            if r in buckets:
                buckets[r].append(p)
            else:
                buckets[r] = [p]
                bits.set(r)

        pair, n_tokens = self.pair.get, len(self.tokens)
        ids_at, left_at, right_at, have_at = ids.item, left.item, right.item, have.item
        push(np.flatnonzero(have >= 0))
        while (r := bits.first()) >= 0:
            bits.clear(r)
            held = buckets.pop(r)
            at = np.concatenate([np.atleast_1d(x) for x in held]) if len(held) > 1 else np.atleast_1d(held[0])
            if len(at) >= _WIDE:
                at = np.sort(at[have[at] == r])  # the rest is stale
                if not len(at):
                    continue
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                # overlapping pairs (aaa): of a run of neighbours, every other one
                chained = np.concatenate([[False], at[1:] == right[at[:-1]]])
                if chained.any():
                    run_start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - run_start) % 2 == 0]
                if r in self.unsafe:
                    at = self._in_order(r, at, ids, left, right, piece, buckets, bits)
                gone = right[at]
                after = right[gone]
                ids[at] = r
                ids[gone] = -1
                have[gone] = -1
                right[at] = after
                ok = after >= 0
                left[after[ok]] = at[ok]
                before = left[at]
                prev = before[before >= 0]
                touched = np.concatenate([at, prev])
                new = np.full(len(touched), -1, np.int64)
                inner = right[touched] >= 0
                new[inner] = self._pair_ranks(ids[touched[inner]], ids[right[touched[inner]]])
                have[touched] = new
                push(touched)
                continue
            todo = sorted(at.tolist())
            for k, p in enumerate(todo):
                if have_at(p) != r:
                    continue  # stale
                gone = right_at(p)
                after = right_at(gone)
                ids[p] = r
                ids[gone] = have[gone] = -1
                right[p] = after
                before = left_at(p)
                lower = False
                if after >= 0:
                    left[after] = p
                    rank = pair(r * n_tokens + ids_at(after), -1)
                    have[p] = rank
                    if rank >= 0:
                        push_one(p, rank)
                        lower = rank < r
                else:
                    have[p] = -1
                if before >= 0:
                    rank = pair(ids_at(before) * n_tokens + r, -1)
                    have[before] = rank
                    if rank >= 0:
                        push_one(before, rank)
                        lower |= rank < r
                if lower and k + 1 < len(todo):  # a lower rank goes before what is left of this bucket
                    buckets.setdefault(r, []).extend(todo[k + 1 :])
                    bits.set(r)
                    break


    def _in_order(self, r, at, ids, left, right, piece, buckets, bits) -> np.ndarray:
        """The positions that can be merged at once: in each piece up to the
        first whose merge makes a pair of a rank below r, as that one goes
        before the rest, which goes back into the bucket."""
        after, before = right[right[at]], left[at]
        made = np.full(len(at), r)
        joins = np.concatenate([[False], before[1:] == right[at[:-1]]])  # the neighbour has just been made
        follows, leads = after >= 0, before >= 0
        low = np.zeros(len(at), bool)
        rank = self._pair_ranks(made[follows], ids[after[follows]])
        low[follows] = (rank >= 0) & (rank < r)
        rank = self._pair_ranks(np.where(joins, r, ids[before])[leads], made[leads])
        low[leads] |= (rank >= 0) & (rank < r)
        if not low.any():
            return at
        starts = np.flatnonzero(np.concatenate([[True], piece[at[1:]] != piece[at[:-1]]]))
        before_low = np.cumsum(low) - low  # low ones before this position
        base = np.repeat(before_low[starts], np.diff([*starts, len(at)]))
        now = before_low == base
        if not now.all():
            buckets.setdefault(r, []).append(at[~now])
            bits.set(r)
        return at[now]


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
        return True
    except UnicodeDecodeError:
        return False


class Encoder:
    """Texts to ids and back, with the worker's memory of pieces and words."""

    def __init__(self, tokens: list[bytes], pattern: str, by_space: bool = True):
        self.pairs = BytePairs(tokens)
        self.tokens = tokens
        self.by_space = by_space
        self.split = unicode_pattern(pattern).findall
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes | None] = {}  # None: white space at an edge
        self._forget()

    def _forget(self) -> None:
        """Keep what is a token itself, drop the rest beyond the bound."""
        if not self.known or len(self.known) > CACHE:
            whole = ((t, r.to_bytes(4, "little")) for r, t in enumerate(self.tokens))
            self.known = {t.decode(): ids for t, ids in whole if _is_utf8(t)}
        if len(self.words) > CACHE:
            self.words = {}

    def _learn(self, pieces: Iterable[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        self.known.update(zip(new, self.pairs.merge([p.encode() for p in new])))

    def _ids(self, texts: list[str]) -> list[bytes]:
        cut = [self.split(t) for t in texts]
        self._learn(set().union(*cut))
        known = self.known.__getitem__
        return [b"".join(map(known, pieces)) for pieces in cut]

    def _learn_words(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.words]
        self.words.update(dict.fromkeys(new))
        inner = [w for w in new if w and w == w.strip()]
        if not inner:
            return
        # cut together: only a word's first piece begins with a space
        pieces = self.split(" " + " ".join(inner))
        self._learn(set(pieces))
        ids = list(map(self.known.__getitem__, pieces))
        starts = [i for i, p in enumerate(pieces) if p[0] == " "]
        self.words.update(
            (w, ids[a] if b - a == 1 else b"".join(ids[a:b])) for w, a, b in zip(inner, starts, [*starts[1:], len(ids)])
        )

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK_CHARS):
                size += len(texts[to])
                to += 1
            self._forget()
            out += self._spaced(texts[at:to]) if self.by_space else self._ids(texts[at:to])
            at = to
        return out

    def _spaced(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") for t in texts]
        heads = [words.pop(0) for words in cut]
        self._learn_words(set().union(*cut))
        word = self.words.__getitem__
        out = self._ids(heads)
        odd = []
        for i, words in enumerate(cut):
            try:
                if heads[i][-1:].isspace():
                    raise TypeError
                out[i] += b"".join(map(word, words))
            except TypeError:  # a None among them
                odd.append(i)
        for i, ids in zip(odd, self._ids([texts[i] for i in odd])):
            out[i] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict = {}  # of the worker


def _encoder(tokens: list[bytes], pattern: str) -> Encoder:
    key = (hash(tuple(tokens)), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokens, pattern)
    return _ENCODERS[key]


def with_ids(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``docs`` and a binary column of ids (little-endian, 4 bytes each); with
    ``decoded`` also a column of the bytes that those ids stand for, so that one
    worker per task does both.  The vocabulary is the driver's file, broadcast
    (under a MB).  Columns named like the results are replaced."""
    added = [out, *([decoded] if decoded else [])]
    docs = replacing(docs, text_col, *added)
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    at = docs.columns.index(text_col)

    def run(batches):
        coder = _encoder(tokens.value, pattern)
        for batch in parts(batches):
            texts = [x or "" for x in batch.column(at).to_pylist()]
            ids = coder.encode(texts)
            new = [pa.array(ids, pa.binary())]
            if decoded:
                new.append(pa.array([coder.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *added])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(c, T.BinaryType()) for c in added]]))


def with_bytes(coded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """``coded`` and the bytes that its ids stand for; a column of their name is replaced."""
    coded = replacing(coded, ids_col, out)
    tokens = coded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    at = coded.columns.index(ids_col)

    def run(batches):
        vocabulary = tokens.value
        for batch in parts(batches):
            rows = (np.frombuffer(x or b"", "<u4").tolist() for x in batch.column(at).to_pylist())
            raw = pa.array([b"".join(map(vocabulary.__getitem__, ids)) for ids in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=[*batch.schema.names, out])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField(out, T.BinaryType())]))


def n_ids(ids_col: str = "ids"):
    return (F.octet_length(ids_col) / 4).cast("long")
