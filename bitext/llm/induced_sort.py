"""Suffix sorting by external induced sorting.

Suffixes are S-type (smaller than the next) or L-type; the leftmost S-type ones
(LMS) are sorted first: their substrings are sorted by one induction and named,
and while names repeat the string of names is sorted the same way, one level
down.  From the sorted LMS suffixes a forward sweep induces all L-type, and a
backward sweep all S-type suffixes.

A sweep is driven by a priority queue of (symbol, type, arrival) tuples with the
suffix's position.  Entries that wait for a later range of symbols lie in
buckets, in arrival order, and go to a scratch file of the task when they
outgrow memory; the bucket in work is kept sorted.  Tuples are taken in runs:
the longest prefix of the queue into which nothing that it induces can fall, so
each step is a few array operations.  Arrays above ``IN_MEMORY`` bytes are
memory-mapped scratch files.  Scratch is private to the task and deleted with
it; a lost task is simply run again."""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np

IN_MEMORY = 64 << 20
_BUCKETS = 1024
_LOOK = 1 << 16  # entries looked at for one run


class Scratch:
    """Arrays in memory or, when large, in files of a folder that goes away."""

    def __init__(self, in_memory: int = IN_MEMORY):
        self.in_memory, self._dir, self._n = in_memory, None, 0

    def path(self) -> Path:
        if self._dir is None:
            self._dir = tempfile.TemporaryDirectory(prefix="induced-")
        self._n += 1
        return Path(self._dir.name) / str(self._n)

    def array(self, n: int, dtype=np.int64) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.in_memory:
            return np.zeros(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))

    def close(self) -> None:
        if self._dir is not None:
            self._dir.cleanup()
            self._dir = None


class _Queue:
    """Buckets of positions by key range, in arrival order, spilled when large."""

    def __init__(self, n_keys: int, scratch: Scratch):
        self.width = max(1, -(-n_keys // _BUCKETS))
        n = -(-n_keys // self.width)
        self.held: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.files: list[Path | None] = [None] * n
        self.scratch, self.size = scratch, 0

    def push(self, keys: np.ndarray, at: np.ndarray) -> None:
        bucket = keys // self.width
        order = np.argsort(bucket, kind="stable")
        bucket, at = bucket[order], at[order]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist() if len(at) else [0]
        for b, i, j in zip(bucket[edges[:-1]].tolist(), edges, edges[1:]):
            self.held[b].append(at[i:j])
        self.size += at.nbytes
        if self.size > self.scratch.in_memory:
            self._spill()

    def _spill(self) -> None:
        for b, parts in enumerate(self.held):
            if parts:
                if self.files[b] is None:
                    self.files[b] = self.scratch.path()
                with open(self.files[b], "ab") as f:
                    for p in parts:
                        f.write(np.ascontiguousarray(p, np.int64).tobytes())
                self.held[b] = []
        self.size = 0

    def take(self, b: int) -> np.ndarray:
        parts = self.held[b]
        self.held[b] = []
        out = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.size -= out.nbytes
        if self.files[b] is not None:
            out = np.concatenate([np.fromfile(self.files[b], np.int64), out])
            self.files[b].unlink()
            self.files[b] = None
        return out


def _sweep(key: np.ndarray, induced: np.ndarray, seeds: np.ndarray, n_keys: int, total: int, scratch: Scratch) -> np.ndarray:
    """Positions in the order of (key, arrival): the seeds, and before an entry's
    turn is over the position before it, where ``induced`` holds."""
    queue = _Queue(n_keys, scratch)
    for i in range(0, len(seeds), 1 << 20):
        part = np.asarray(seeds[i : i + (1 << 20)])
        queue.push(key[part], part)
    out, done = scratch.array(total), 0
    for b in range(len(queue.held)):
        now = queue.take(b)
        keys = key[now]
        order = np.argsort(keys, kind="stable")
        now, keys = now[order], keys[order]
        top = (b + 1) * queue.width
        while len(now):
            look = now[:_LOOK]
            before = look - 1
            ok = before >= 0
            ok[ok] = induced[before[ok]]
            pre = np.where(ok, key[np.where(ok, before, 0)], n_keys)
            least = np.minimum.accumulate(pre)
            late = np.flatnonzero(least[:-1] < keys[1 : len(look)])
            cut = int(late[0]) + 1 if len(late) else len(look)
            out[done : done + cut] = look[:cut]
            done += cut
            new, new_keys = before[:cut][ok[:cut]], pre[:cut][ok[:cut]]
            now, keys = now[cut:], keys[cut:]
            here = new_keys < top
            if not here.all():
                queue.push(new_keys[~here], new[~here])
            if here.any():
                mine, mine_keys = new[here], new_keys[here]
                if len(now) and mine_keys.max() < keys[0] or not len(now):
                    order = np.argsort(mine_keys, kind="stable")
                    now = np.concatenate([mine[order], now])
                    keys = np.concatenate([mine_keys[order], keys])
                else:
                    now, keys = np.concatenate([now, mine]), np.concatenate([keys, mine_keys])
                    order = np.argsort(keys, kind="stable")
                    now, keys = now[order], keys[order]
    return out[:done]


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is S-type; the last one is."""
    n = len(text)
    step = np.sign(np.diff(text))
    at = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # the next place where symbols differ
    out = np.ones(n, bool)
    inner = nearest < n
    out[:-1][inner] = step[nearest[inner]] > 0
    return out


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the LMS substrings, by position, and how many differ."""
    n = len(text)
    end = np.append(lms[1:], n - 1)
    size_at = np.zeros(n, np.int64)
    size_at[lms] = end - lms + 1
    a, b = ordered[:-1], ordered[1:]
    same = size_at[a] == size_at[b]
    sizes = size_at[a]
    rows = np.flatnonzero(same)
    depth = 0
    while len(rows):  # symbol by symbol, dropping pairs that differ or are at their end
        x, y = a[rows] + depth, b[rows] + depth
        equal = text[x] == text[y]
        same[rows[~equal]] = False
        depth += 1
        rows = rows[equal]
        rows = rows[sizes[rows] > depth]
    name = np.concatenate([[0], np.cumsum(~same)])
    by_position = np.zeros(n, np.int64)
    by_position[ordered] = name
    return by_position[lms], int(name[-1]) + 1


def suffix_array(text: np.ndarray, n_symbols: int, scratch: Scratch) -> np.ndarray:
    """Positions of all suffixes in order.  The last symbol is the only least one."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    forward, backward = 2 * text + small, 2 * (n_symbols - 1 - text) + ~small

    def induce(seeds: np.ndarray) -> np.ndarray:
        """All suffixes in order, from the LMS ones in order (the last included)."""
        up = _sweep(forward, ~small, seeds, 2 * n_symbols, n, scratch)
        large = up[~small[up]]
        down = _sweep(backward, small, large[::-1], 2 * n_symbols, n, scratch)
        return np.concatenate([[n - 1], down[::-1]])

    if len(lms) > 1:
        by_text = lms[np.argsort(text[lms], kind="stable")]
        order = induce(by_text)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = order[is_lms[order]]
        names, n_names = _names(text, lms, ordered)
        if n_names < len(lms):
            ordered = lms[suffix_array(names, n_names, scratch)]
        return induce(ordered)
    return induce(lms)
