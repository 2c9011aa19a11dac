"""Pseudo-random numbers that any engine with md5 can repeat, whatever the
partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts: Column) -> Column:
    """32 bits of the md5 of the parts joined by '|'."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """In (0, 1), never 0 or 1."""
    return (hash32(*parts).cast("double") + 0.5) / F.lit(4294967296.0)
