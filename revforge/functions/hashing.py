"""Seeded, engine-independent pseudo-random keys.

``md5(seed ':' id)`` gives the same hex string in every SQL engine, so ranks and buckets built on
it can be checked against an independent engine (``rand(seed)`` could not).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int | str, id_col: Column | str) -> Column:
    """Hex md5 of ``'<seed>:<id>'``; a string sort key."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def hash_int(seed: int | str, id_col: Column | str) -> Column:
    """First 15 hex digits of the md5 as a non-negative bigint (60 bits)."""
    return F.conv(F.substring(hash_key(seed, id_col), 1, 15), 16, 10).cast("long")


def hash_bucket(seed: int | str, id_col: Column | str, buckets: int) -> Column:
    return F.pmod(hash_int(seed, id_col), F.lit(buckets))


def hash_unit(seed: int | str, id_col: Column | str) -> Column:
    """A double in [0, 1): the 60-bit hash over 2^60."""
    return hash_int(seed, id_col).cast("double") / F.lit(float(1 << 60))
