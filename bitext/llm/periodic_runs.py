"""Periodic run detection by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), at least ``min_length`` and 2 q words long, that no neighbouring
word extends keeping the period.

Many texts are searched together as one sequence of numbers.  A word's number
depends on its text, too, and every text ends in a number of its own, so nothing
equal lies in two texts.

* ``Factors`` sorts the suffixes by doubling.  It keeps the ranks of all
  substrings of 1, 2, 4, ... words; a rank is the first place of its substring's
  suffixes in the suffix array, and two ranks a level give common extensions.
* ``Wavelet`` is a wavelet tree (matrix layout, packed bits) over the suffix array.  The
  range successor of x in an interval is the next occurrence of a block from x on.
* For every level with blocks of B words, a run of period 2 B - 1 to 4 B - 2 holds
  a whole dyadic block in its first period and an occurrence of it one period on.
  So each block asks for its occurrences in the window behind it (``candidates``).
  Occurrences at most B / 2 apart form an arithmetic progression: the block has a
  period p, and the progression is one stretch of that period.  A stretch is asked
  for once; its start and its end, held against the start and the end of the block's
  own stretch, give the periods.  Only where the two stretches touch, any period
  of the progression can make a run, and all within the window are tried.
* A candidate (place, period) is extended to both sides by common extensions,
  which shows its exact ends.  Equal stretches keep the smallest period.

One level's blocks ask O(1) times each and half as many blocks are on the next
level, so a text of n words costs O(n log n).  Every text lies in one row and is
searched in one task; a block of short texts has about ``BLOCK_WORDS`` words.

Edge cases: null and empty texts have no words, hence no runs and the collapsed
text ''; repeated rows each get their row; a null id stays; an empty table gives
no rows; columns other than id and text are not read, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext.llm.common import byte_texts, parts, text_of

MIN_LENGTH = 12
BLOCK_WORDS = 1 << 17

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class Factors:
    """Suffix array and the ranks of all substrings of 1, 2, 4, ... symbols.

    Every symbol that ends a text must occur once only."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        #: per level: the repeated substrings' places and the ends of their intervals
        self.repeated: list[tuple[np.ndarray, np.ndarray]] = []
        self.ranks = [np.empty(n, np.int32)]
        self.order = order.astype(np.int32)
        slots, places, key = np.arange(n), order, symbols[order]
        while True:
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(first, len(key)))
            at = np.repeat(slots[first], sizes)
            self.order[slots] = places
            self.ranks[-1][places] = at
            many = np.repeat(sizes > 1, sizes)
            slots, places, at = slots[many], places[many], at[many]
            self.repeated.append((places, at + np.repeat(sizes[sizes > 1], sizes[sizes > 1])))
            if not len(places):
                break
            rank, width = self.ranks[-1], 1 << (len(self.ranks) - 1)
            key = at.astype(np.int64) * n + rank[places + width]
            turn = np.argsort(key, kind="stable")
            key, places = key[turn], places[turn]
            self.ranks.append(rank.copy())

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols in common from a and b on (a and b differ)."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            step = (self.ranks[k][a] == self.ranks[k][b]).astype(np.int64) << k
            a += step
            b += step
        return a - start

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols in common before a and b."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a - (1 << k), b - (1 << k)
            inside = (x >= 0) & (y >= 0)
            same = inside & (self.ranks[k][np.where(inside, x, 0)] == self.ranks[k][np.where(inside, y, 0)])
            step = same.astype(np.int64) << k
            a -= step
            b -= step
        return start - a


class Wavelet:
    """Range successor over a permutation."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for bit in range(max(1, (self.n - 1).bit_length()) - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            packed = np.append(np.packbits(one, bitorder="little"), np.uint8(0))
            before = np.zeros(len(packed), np.int32)
            np.cumsum(np.bitwise_count(packed[:-1]), dtype=np.int32, out=before[1:])
            zeros = self.n - int(before[-1])
            self.levels.append((bit, packed, before, zeros))
            values = np.concatenate([values[~one], values[one]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        byte = at >> 3
        part = packed[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)
        return before[byte] + np.bitwise_count(part).astype(np.int64)

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value >= ``least`` in places lo to hi - 1; n if there is none."""
        rank = np.zeros(len(lo), np.int64)
        a, b = lo.astype(np.int64), hi.astype(np.int64)
        for bit, packed, before, zeros in self.levels:  # how many are smaller
            a1, b1 = self._ones(packed, before, a), self._ones(packed, before, b)
            up = (least >> bit) & 1 == 1
            rank += np.where(up, (b - b1) - (a - a1), 0)
            a, b = np.where(up, zeros + a1, a - a1), np.where(up, zeros + b1, b - b1)
        out = np.full(len(lo), self.n, np.int64)
        some = np.flatnonzero((rank < hi - lo) & (least < self.n))
        a, b, rank = lo[some].astype(np.int64), hi[some].astype(np.int64), rank[some]
        value = np.zeros(len(some), np.int64)
        for bit, packed, before, zeros in self.levels:  # the one after them
            a1, b1 = self._ones(packed, before, a), self._ones(packed, before, b)
            small = (b - b1) - (a - a1)
            up = rank >= small
            rank -= np.where(up, small, 0)
            value |= up.astype(np.int64) << bit
            a, b = np.where(up, zeros + a1, a - a1), np.where(up, zeros + b1, b - b1)
        out[some] = value
        return out


def candidates(
    factors: Factors, occurrences: Wavelet, level: int, least: int, most: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) that the blocks of 2 ** level symbols give for runs of
    period ``least`` to ``most``."""
    size = 1 << level
    places, ends = factors.repeated[level]
    aligned = places & (size - 1) == 0
    at, hi = places[aligned].astype(np.int64), ends[aligned].astype(np.int64)
    lo = factors.ranks[level][at].astype(np.int64)
    last, after = at.copy(), at + 1
    period, own_start, own_end = np.zeros_like(at), at.copy(), at.copy()
    while len(at):
        found = occurrences.successor(lo, hi, after)
        near = (found <= at + most) & (found < occurrences.n)
        at, lo, hi, last, period, own_start, own_end, found = (
            x[near] for x in (at, lo, hi, last, period, own_start, own_end, found)
        )
        if not len(at):
            return
        yield at, found - at
        new = (period == 0) & (2 * (found - last) <= size)  # two of a progression
        period[new] = (found - last)[new]
        own_start[new] = at[new] - factors.behind(at[new], at[new] + period[new])
        own_end[new] = at[new] + period[new] + factors.ahead(at[new], at[new] + period[new])
        after = found + 1
        of = np.flatnonzero(period)
        if len(of):
            one, p = np.where(new, last, found)[of], period[of]
            start = one - factors.behind(one, one + p)
            end = one + p + factors.ahead(one, one + p)
            after[of] = end - size + 1
            other = one != at[of]
            here, p, one, start, end = at[of][other], p[other], one[other], start[other], end[other]
            first, past = own_start[of][other], own_end[of][other]
            yield here, start - first
            yield here, end - past
            touch = start <= past
            if touch.any():
                here, p, off = here[touch], p[touch], (one - here)[touch]
                low = least + (off - least) % p
                times = np.maximum(0, (most - low) // p + 1)
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                yield np.repeat(here, times), np.repeat(low, times) + step * np.repeat(p, times)
        last = found


def find_runs(symbols: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period."""
    n = len(symbols)
    none = np.zeros(0, np.int64)
    factors = Factors(symbols)
    found_at, found_periods = [none], [none]
    base = 0 if min_length < 5 else 1  # from five words on, blocks of two words serve the periods 1 to 6
    occurrences = None
    for level in range(base, len(factors.ranks)):
        if not len(factors.repeated[level][0]):
            break
        if occurrences is None:
            occurrences = Wavelet(factors.order.astype(np.int64))
        size = 1 << level
        for at, period in candidates(factors, occurrences, level, 1 if level == base else 2 * size - 1, 4 * size - 2):
            ok = (period > 0) & (at + period < n)
            found_at.append(at[ok])
            found_periods.append(period[ok])
    pairs = np.unique(np.concatenate(found_at) * (n + 1) + np.concatenate(found_periods))
    at, period = pairs // (n + 1), pairs % (n + 1)
    start = at - factors.behind(at, at + period)
    end = at + period + factors.ahead(at, at + period)
    ok = end - start >= np.maximum(min_length, 2 * period)
    start, end, period = start[ok], end[ok], period[ok]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)  # of equal stretches the smallest period
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _searched(texts: list[list[bytes]], min_length: int) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and collapsed text of each text's words."""
    known: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.fromiter((known.setdefault(w, len(known)) for words in texts for w in words), np.int64, int(sizes.sum()))
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    symbols = owner * (len(known) + 1)
    inner = np.ones(len(symbols), bool)
    inner[begin[1:] - 1] = False  # the end of a text is the least of its numbers
    symbols[inner] += codes + 1
    start, end, period = find_runs(symbols, min_length)
    runs: list[list[dict]] = [[] for _ in texts]
    dropped = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, end, -1)
    dropped = np.cumsum(dropped)
    for d, s, e, q in zip(owner[start].tolist(), start.tolist(), end.tolist(), period.tolist()):
        runs[d].append({"start": s - int(begin[d]), "length": e - s, "period": q})
    left = []
    for d, words in enumerate(texts):
        if runs[d]:
            gone = dropped[begin[d] : begin[d] + len(words)].tolist()
            words = [w for w, g in zip(words, gone) if not g]
        left.append(b" ".join(words))
    return runs, left


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH
) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and period), collapsed:
    the words that no run holds after its first period, joined by one space.

    Words are what lies between ASCII white space."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches):
        for part in parts(batches):
            ids, done = part.column(0), 0
            block: list[list[bytes]] = []
            size = 0
            for i, text in enumerate(byte_texts(part.column(1)), 1):
                block.append(text.split())
                size += len(block[-1])
                if size >= BLOCK_WORDS or i == len(ids):
                    runs, left = _searched(block, min_length)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(done, len(block)), pa.array(map(len, block), pa.int64()),
                         pa.array(runs, pa.list_(_RUN)), pa.array(left, pa.binary()).cast(pa.string())],
                        names=["doc_id", "n_words", "runs", "collapsed"],
                    )
                    done, block, size = i, [], 0

    return rows.mapInArrow(run, _SCHEMA)
