"""Row samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_sample(key: Column, fraction: float) -> Column:
    """True for a share of the key values, the same ones in every run and engine.

    The first eight hex digits of the key's MD5 are compared as text with the
    share of the 32-bit range, so all rows of a key go together.
    """
    edge = f"{sample_edge(fraction):08x}"
    return F.substring(F.md5(key.cast("string").cast("binary")), 1, 8) < edge


def sample_hash(key: Column) -> Column:
    """The number that ``in_sample`` compares: the first 32 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def sample_edge(fraction: float) -> int:
    return min(int(fraction * 2**32), 2**32 - 1)
