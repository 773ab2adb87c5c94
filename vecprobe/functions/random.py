"""Portable seeded randomness: md5 of '|'-joined keys.

Every engine with md5 can reproduce these draws exactly, unlike a
library RNG; keys must be integers or strings (never doubles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _s(c) -> Column:
    if isinstance(c, Column):
        return c.cast("string")
    if isinstance(c, str):
        return F.col(c).cast("string")
    return F.lit(str(c))


def hash_key(*parts) -> Column:
    """Sort key: md5 hex of 'p1|p2|...'. Use as the order of a permutation."""
    return F.md5(F.concat_ws("|", *[_s(p) for p in parts]))


def hash_int(*parts) -> Column:
    """Integer draw in [0, 2^32): first 8 hex digits of the md5 key."""
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("bigint")


def hash_long(*parts) -> Column:
    """Integer draw in [0, 2^60): first 15 hex digits of the md5 key."""
    return F.conv(F.substring(hash_key(*parts), 1, 15), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    """Uniform draw in [0, 1)."""
    return hash_int(*parts) / F.lit(4294967296.0)
