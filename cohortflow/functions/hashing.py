"""Seeded pseudo-random keys from MD5 text, the same on every engine and every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: Column | int, *parts: Column) -> Column:
    """MD5 hex text of `seed|part|...`."""
    head = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("|", head.cast("string"), *[p.cast("string") for p in parts]))


def hash_to_long(hex_text: Column, digits: int = 15) -> Column:
    """Leading hex digits as a whole number below 16**digits."""
    return F.conv(F.substring(hex_text, 1, digits), 16, 10).cast("long")


def seeded_index(n: Column, seed: Column | int, *parts: Column) -> Column:
    """Draw in 0..n-1."""
    return hash_to_long(seeded_hash(seed, *parts)) % n
