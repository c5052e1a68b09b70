"""Benchmark decontamination: Wu-Manber search over words.

Words are the symbols.  Test items are cut into windows of ``width``
consecutive words (a shorter item is one window).  Windows of one length
share a shift table over blocks of two words: the block that ends at the
current position tells how many words can be skipped, as no window can end
there; a zero shift opens the bucket of windows with that suffix block, and
direct comparison confirms.

Items are broadcast in blocks of at most ``BLOCK_BYTES`` of text, each
collected, broadcast and dropped before the next; a worker holds the items
and tables of one block at a time, so its memory is bounded by ``BLOCK_BYTES``
for any number of items, and the blocks themselves wait on the executor's disk.

Edge cases: null and wordless texts have no words and are clean; items
without words never occur; items with a null id report as ''; repeated item
rows count once; further columns pass through untouched."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitext.llm.common import byte_texts, fresh, parts, replacing

WIDTH = 13
BLOCK_BYTES = 8 << 20

#: Every byte below 0x80 that is no digit or letter parts words; A-Z fold to a-z.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WordSearch:
    """Shift and bucket tables for windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[str]]):
        self.length, self.windows = length, windows
        self.block = min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(set)
        for window in windows:
            for end in range(self.block, length + 1):
                block = window[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.skip), length - end)
            self.bucket[window[-self.block :]].add(window)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        shift, skip, back, width = self.shift.get, self.skip, self.block - 1, self.length
        end, n = width - 1, len(words)
        while end < n:
            block = tuple(words[end - back : end + 1])
            step = shift(block, skip)
            if step:
                end += step
                continue
            start = end - width + 1
            here = tuple(words[start : end + 1])
            if here in self.bucket[block]:
                yield start, here
            end += 1


def searches(items: list[tuple[str, bytes]], width: int = WIDTH) -> list[WordSearch]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            window = tuple(words[i : i + width])
            by_length[len(window)][window].add(item)
    return [WordSearch(n, windows) for n, windows in sorted(by_length.items(), reverse=True)]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    rows = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    ).filter(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, bytes(r.text)) for r in part.collect()]


_TABLES: dict = {}  # of the worker: the tables of the last block


def _tables(broadcast, width: int) -> list[WordSearch]:
    if id(broadcast) not in _TABLES:
        _TABLES.clear()
        _TABLES[id(broadcast)] = (broadcast, searches(broadcast.value, width))
        # a Broadcast keeps what it has read; dropped, it is read from its file when needed again
        vars(broadcast).pop("_value", None)
    return _TABLES[id(broadcast)][1]


_FOUND = "n_words bigint, spans array<struct<first:bigint,past:bigint>>, items array<string>"


def with_occurrences(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WIDTH, found: str = "found",
) -> DataFrame:
    """``docs`` and a struct column: n_words, the merged word spans that occur
    in the items, and the ids of the items they come from.  A column of its name
    is replaced."""
    docs = replacing(docs, text_col, found)
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(rows) for rows in _blocks(items, item_id, item_text)]
    at = docs.columns.index(text_col)
    kind = pa.struct(
        [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))),
         ("items", pa.list_(pa.string()))]
    )

    def scan(batches):
        for batch in batches if len(blocks) > 1 else parts(batches):
            hits: dict[int, list] = defaultdict(list)
            texts = byte_texts(batch.column(at))
            n_words = [0] * len(texts)
            for block in blocks:
                tables = _tables(block, width)
                for i, text in enumerate(texts):
                    words = words_of(text)
                    n_words[i] = len(words)
                    for table in tables:
                        for start, window in table.find(words):
                            hits[i].append((start, start + table.length, table.windows[window]))
            out = []
            for i in range(len(texts)):
                spans: list[dict] = []
                ids: set[str] = set()
                for first, past, which in sorted(hits.get(i, ()), key=lambda h: h[:2]):
                    ids |= which
                    if spans and first <= spans[-1]["past"]:
                        spans[-1]["past"] = max(past, spans[-1]["past"])
                    else:
                        spans.append({"first": first, "past": past})
                out.append({"n_words": n_words[i], "spans": spans, "items": sorted(ids)})
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, found]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(found, T.StructType.fromDDL(_FOUND))])
    return docs.mapInArrow(scan, schema)


def hit_words(found: str = "found") -> Column:
    lengths = F.transform(F.col(f"{found}.spans"), lambda s: s["past"] - s["first"])
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b)


def is_contaminated(found: str = "found") -> Column:
    """At least a twentieth of the words lie in occurrences."""
    n_hit = hit_words(found)
    return (n_hit > 0) & (20 * n_hit >= F.col(f"{found}.n_words"))


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    found = fresh(docs, "found")
    marked = with_occurrences(docs, items, text_col, found=found)
    return marked.filter(~is_contaminated(found)).drop(found)
