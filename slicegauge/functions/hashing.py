"""Reproducible draws: randomness is an md5 order, so partitioning never matters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Number of buckets a group is cut into by `hash_bucket` (four hex digits).
HASH_BUCKETS = 65536


def draw_key(seed: int, purpose: str, *parts: Column) -> Column:
    """md5 hex of 'seed:purpose:part:...'; sorting by it is a random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose),
                             *[p.cast("string") for p in parts]))


def draw_int(key: Column) -> Column:
    """First 60 bits of a draw key as a non-negative long: no pool is too large for it."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")


def hash_bucket(key: Column) -> Column:
    """Leading 16 bits of a draw key: an even, order-keeping cut of a group."""
    return F.conv(F.substring(key, 1, 4), 16, 10).cast("int")
