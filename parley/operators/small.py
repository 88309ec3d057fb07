"""Broadcasts whose size is looked at first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast.
FEW = 50_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, to be broadcast if it has ``most`` rows at most; else as it is, and Spark chooses the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
