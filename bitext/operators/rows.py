"""Rows with token arrays, worked on in the task that holds them.

A row's tokens stay together: the compact rows are dealt and sorted by their key once,
and whole Arrow batches of them are looked up, cut or counted with numpy.  No token
is a row of its own, and words are cut from a text after the sort, so no join, sort
or spill grows with the tokens.  A text of words that stand one space apart ('' has
none) may take the place of an array of them: it is cut by Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = "__rows"


def map_rows(
    df: DataFrame,
    key: Sequence[str],
    cols: Mapping[str, Column],
    fn: Callable[[pa.ListArray], Sequence[pa.Array]],
    out: Sequence[T.StructField],
    deal: Sequence[str] = (),
    lengths: Mapping[str, str] | None = None,
    unique: bool = False,
    size: int = 10_000,
) -> DataFrame:
    """The key columns, the sizes ``lengths`` of some of ``cols``, and the arrays that ``fn``
    makes of ``ROWS``, the structs of ``cols`` of all rows that agree in these and the key
    (at most ``size`` keys at once).  What ``cols`` read is dealt by ``deal`` (the key, if
    not given) and sorted by key, and they are computed after that: of words that are cut
    from a text, the text moves, and a sort never holds or spills an array of them.  Rows
    that are ``unique`` by key stay where they are."""
    lengths = lengths or {}
    if not unique:
        df = df.repartition(*(deal or key)).sortWithinPartitions(*key)
    rows = df.select(*key, *[c.alias(name) for name, c in cols.items()])
    rows = rows.select(*key, *_sizes(rows, lengths), F.struct(*cols).alias(ROWS))
    by, n_key = [*key, *lengths], len(key)
    names = [*by, *[f.name for f in out]]

    def run(batches):
        for b in batches if unique else _whole_keys(batches, n_key):
            columns, groups = b.columns[:-1], _alone(b.column(len(by)))
            if not unique and not (begins := _begins(columns[:n_key])).all():
                columns, groups, _ = _gathered(columns, b.column(len(by)), begins, n_key)
            for at in range(0, len(groups), size):
                part = groups.slice(at, size)
                yield pa.RecordBatch.from_arrays([*[c.slice(at, size) for c in columns], *fn(part)], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.select(*by).schema.fields, *out]))


def join_rows(
    df: DataFrame,
    key: str,
    cols: Mapping[str, Column],
    fn: Callable[[pa.ListArray], Sequence[pa.Array]],
    out: Sequence[T.StructField],
    lengths: Mapping[str, str],
    size: int = 10_000,
) -> DataFrame:
    """``df`` joined by its key with what ``map_rows`` makes of it, without a join: the rows are
    dealt once as they are, and each is put out with every result of its key.  Rows
    without a key go, as in a join."""
    rest = [c for c in df.columns if c != key]
    df = df.select(key, *rest).where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key)
    names = [f"__{name}" for name in cols]  # beside columns that may have these names
    rows = df.select("*", *[c.alias(x) for c, x in zip(cols.values(), names)])
    sizes = _sizes(rows, {name: f"__{c}" for name, c in lengths.items()})
    struct = F.struct(*[F.col(x).alias(name) for x, name in zip(names, cols)])
    rows = rows.select(key, *rest, *sizes, struct.alias(ROWS))
    n = 1 + len(rest)
    by = rows.columns[:-1]

    def run(batches):
        for b in _whole_keys(batches, 1):
            own, counted, held = b.columns[:n], b.columns[n:-1], b.column(len(by))
            begins = _begins(own[:1])
            groups, row, of = _alone(held), None, None
            if not begins.all():  # each row with all groups of its key, which follow each other
                number, (_, *counted), groups, first = np.cumsum(begins) - 1, *_gathered([own[0], *counted], held, begins, 1)
                n_groups = np.bincount(number[first])
                before = (np.cumsum(n_groups) - n_groups)[number]
                row = np.repeat(np.arange(b.num_rows), n_groups[number])
                of = np.arange(len(row)) - np.repeat(np.cumsum(n_groups[number]) - n_groups[number] - before, n_groups[number])
            made = [fn(groups.slice(at, size)) for at in range(0, len(groups), size)]
            results = [*counted, *[pa.concat_arrays(x) for x in zip(*made)]]
            for at in range(0, b.num_rows if row is None else len(row), size):
                if row is None:
                    columns = [c.slice(at, size) for c in (*own, *results)]
                else:
                    columns = [c.take(pa.array(x[at : at + size])) for cs, x in ((own, row), (results, of)) for c in cs]
                yield pa.RecordBatch.from_arrays(columns, names=[*by, *[f.name for f in out]])

    return rows.mapInArrow(run, T.StructType([*rows.select(*by).schema.fields, *out]))


def _sizes(rows: DataFrame, lengths: Mapping[str, str]) -> list[Column]:
    """The number of elements of arrays, or of words of texts."""
    found = []
    for name, c in lengths.items():
        n = F.size(c)
        if isinstance(rows.schema[c].dataType, T.StringType):
            spaces = F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))
            n = F.when(F.col(c) == "", 0).otherwise(spaces + 1)
        found.append(n.cast("long").alias(name))
    return found


def _begins(key: Sequence[pa.Array]) -> np.ndarray:
    """Which rows have another key than the row before."""
    new = np.zeros(len(key[0]), bool)
    new[:1] = True
    for c in key:
        at = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= at[1:] != at[:-1]
    return new


def _whole_keys(batches: Iterator[pa.RecordBatch], n_key: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut anew so that all rows of a key, which follow each other, are in one."""
    held: list[pa.RecordBatch] = []  # rows of the last key
    for b in batches:
        key = b.columns[:n_key]
        if held:
            key = [pa.concat_arrays([x.slice(len(x) - 1), c]) for x, c in zip(held[-1].columns, key)]
        first = np.flatnonzero(_begins(key)) - bool(held)
        first = first[first >= 0]
        if len(first):
            past = int(first[-1])
            whole = [x for x in (*held, b.slice(0, past)) if x.num_rows]
            if whole:
                yield pa.concat_batches(whole)
            held, b = [], b.slice(past)
        if b.num_rows:
            held.append(b)
    if held:
        yield pa.concat_batches(held)


def _alone(rows: pa.StructArray) -> pa.ListArray:
    """Each row as a group."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1), pa.int32()), rows)


def _gathered(
    columns: Sequence[pa.Array], rows: pa.StructArray, begins: np.ndarray, n_key: int
) -> tuple[list[pa.Array], pa.ListArray, np.ndarray]:
    """The distinct rows of ``columns``, a key and sizes, for each the ``rows`` that have it, and
    where it comes first."""
    number = np.cumsum(begins) - 1
    for c in columns[n_key:]:
        of = c.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        number = pd.factorize(number * len(rows) + of)[0]
    first = np.unique(number, return_index=True)[1]
    ends = np.append(0, np.cumsum(np.bincount(number)))
    held = rows.take(pa.array(np.argsort(number, kind="stable")))
    return [c.take(pa.array(first)) for c in columns], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held), first


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of texts that have them one space apart; '' and null have none."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    if not len(texts):
        return pa.array([], pa.list_(pa.string()))
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    letters = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data else np.empty(0, np.uint8)
    space = letters == ord(" ")
    at = np.flatnonzero(space)
    before = np.searchsorted(at, starts - starts[0])  # spaces before each text
    there = starts[1:] > starts[:-1]
    size = (np.diff(before) + 1) * there
    ends = np.append(0, np.cumsum(size))
    stops = np.empty(ends[-1] + 1, np.int32)  # of the words, in the letters without spaces
    stops[0] = 0
    stops[ends[1:][there]] = (starts - starts[0] - before)[1:][there]
    n = np.arange(len(at))
    stops[1 + n + np.repeat(np.cumsum(there) - there, np.diff(before))] = at - n
    words = pa.StringArray.from_buffers(int(ends[-1]), pa.py_buffer(stops), pa.py_buffer(letters[~space]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)


class Tokens:
    """The elements of one array column (or the words of a text column) of ``ROWS``, over a
    batch: ``values``, and for each its ``group`` (the row of the batch), ``line`` (its
    array) and ``pos``."""

    def __init__(self, rows: pa.ListArray, field: str):
        self.groups = len(rows)
        per_group = np.diff(rows.offsets.to_numpy())
        arrays = rows.flatten().field(field)
        if pa.types.is_string(arrays.type) or pa.types.is_large_string(arrays.type):
            arrays = words_of(arrays)
        size = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy().astype(np.int64)
        self.values = arrays.flatten()
        self.repeated = bool((per_group > 1).any())  # a key with several rows
        self.line = np.repeat(np.arange(len(size)), size)
        self.pos = np.arange(len(self.line)) - np.repeat(np.cumsum(size) - size, size)
        self.group = np.repeat(np.arange(self.groups), per_group)[self.line]

    def order(self, rank: np.ndarray) -> np.ndarray:
        """The tokens in order of their position, those of a repeated key's rows by ``rank``."""
        return np.lexsort((rank, self.pos, self.group)) if self.repeated else np.arange(len(self.line))


def lists(group: np.ndarray, groups: int, values: pa.Array, sizes: np.ndarray | None = None) -> pa.ListArray:
    """An array per group; ``sizes``: how many values each entry of ``group`` (ascending) stands for."""
    n = np.bincount(group, weights=sizes, minlength=groups).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)
