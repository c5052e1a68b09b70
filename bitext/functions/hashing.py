"""Seeded, partition-independent row hashing.

The reference draws samples with a random seed.  A seeded hash of the row
key gives the same draw for every partitioning and every re-execution of a
lost task, which ``rand(seed)`` does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(seed, *keys) -> Column:
    """First 32 bits of ``md5(seed ':' key...)`` as a BIGINT in [0, 2^32)."""
    parts = [F.lit(str(seed)), F.lit(":")]
    for i, k in enumerate(keys):
        if i:
            parts.append(F.lit(":"))
        parts.append((F.col(k) if isinstance(k, str) else k).cast("string"))
    digest = F.md5(F.concat(*parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")

