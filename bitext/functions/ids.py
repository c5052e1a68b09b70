"""Id-array expressions (fixed-length vectors for sequence models).

All are higher-order array functions evaluated row-locally: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id 0 is padding, id 1 the unknown token, real tokens from 2.
PAD_ID = 0
UNK_ID = 1
FIRST_TOKEN_ID = 2


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pad_truncate(col, length: int, truncate: str = "post") -> Column:
    """ARR2: pad with 0 at the end to ``length``; on overflow keep the head
    (``truncate='post'``) or the tail (``truncate='pre'``)."""
    ids = _c(col)
    padded_head = F.slice(F.concat(ids, F.array_repeat(F.lit(PAD_ID), length)), 1, length)
    if truncate == "post":
        return padded_head
    if truncate != "pre":
        raise ValueError("truncate must be 'post' or 'pre'")
    tail = F.slice(ids, F.size(ids) - F.lit(length - 1), F.lit(length))
    return F.when(F.size(ids) > length, tail).otherwise(padded_head)


def decoder_input(col) -> Column:
    """ARR4: all but the last id."""
    ids = _c(col)
    return F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))


def shifted_label(col) -> Column:
    """ARR4: all but the first id."""
    ids = _c(col)
    return F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))


def padding_mask(col) -> Column:
    """ARR6: 1.0 where the id is padding, else 0.0."""
    return F.transform(_c(col), lambda x: F.when(x == PAD_ID, F.lit(1.0)).otherwise(F.lit(0.0)))


def strip_pad(col) -> Column:
    """FLT6: drop padding ids."""
    return F.filter(_c(col), lambda x: x != PAD_ID)


def strip_values(col, values) -> Column:
    """FLT7: drop every element equal to one of ``values`` (duplicates of
    other elements are kept, unlike ``array_except``)."""
    vals = F.array(*[F.lit(v) for v in values])
    return F.filter(_c(col), lambda x: ~F.array_contains(vals, x))
