"""Small pieces that several corpus operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of strings (and 32 a row) up to which a table is broadcast; beyond it the join is left to Spark.
BROADCAST_BYTES = 8 << 20


def ascii_lower(c: Column) -> Column:
    """A-Z only, whatever the locale; other letters stay as they are."""
    return F.translate(c, UPPER, UPPER.lower())


def fits(df: DataFrame, size: Column) -> bool:
    """Whether df may be broadcast, by a measured sum of ``size`` (the bytes of a row's strings)."""
    return df.agg(F.coalesce(F.sum(size + 32), F.lit(0))).first()[0] <= BROADCAST_BYTES


def small(df: DataFrame, size: Column) -> DataFrame:
    """Broadcast df if it fits."""
    return F.broadcast(df) if fits(df, size) else df
