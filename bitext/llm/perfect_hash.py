"""Minimal perfect hash over distinct 32-byte digests, in numpy.

Levels of bit arrays: a key that is alone on its bit at a level is placed
there, the rest go on to the next level.  The slot of a key is the rank of
its bit, so n keys fill slots 0..n-1 exactly.  A lookup of a foreign key may
land on any slot; the caller compares the digest bytes kept in the slot."""

from __future__ import annotations

import numpy as np

DIGEST_BYTES = 32
_LOAD = 2  # bits per key at a level
_MAX_LEVELS = 64


def as_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, DIGEST_BYTES // 8)


def _hash(words: np.ndarray, level: int) -> np.ndarray:
    x = words[:, level % 4] + words[:, (level + 1) % 4] * np.uint64(0x9E3779B97F4A7C15)
    x = x + np.uint64(((level + 1) * 0xD1B54A32D192ED03) & (2**64 - 1))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, words: np.ndarray) -> tuple["PerfectHash", np.ndarray]:
        """The function and, for each key, its slot."""
        left, sizes, levels = np.arange(len(words)), [], []
        while len(left):
            if len(sizes) == _MAX_LEVELS:
                raise ValueError("digests are not distinct")
            size = max(64, _LOAD * len(left))
            at = (_hash(words[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        made = cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))
        return made, made.slots(words)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """A candidate slot for each key, -1 where no level has a bit for it."""
        out = np.full(len(words), -1, np.int64)
        left = np.arange(len(words))
        for level, size in enumerate(self.sizes):
            at = (_hash(words[left], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def dump(self) -> tuple[list[int], bytes]:
        return list(self.sizes), np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, sizes, packed: bytes) -> "PerfectHash":
        n = int(sum(sizes))
        bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool) if n else np.zeros(0, bool)
        return cls([int(x) for x in sizes], bits)
