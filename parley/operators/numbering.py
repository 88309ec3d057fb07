"""Gapless numbers and running sums that never gather a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, group: list[str], bucket: Column, order: list[str], name: str, amount: Column | None = None) -> DataFrame:
    """Gapless numbers from 0 (or running sums of ``amount`` before the row) within ``group``.

    Rows are ordered by ``bucket``, an ascending integer, then by ``order``. A group is never
    gathered into one task: each bucket is numbered alone, and what stands before a bucket is
    summed over the small table of buckets.
    """
    b, add = "_bucket", F.lit(1).cast("long") if amount is None else amount.cast("long")
    df = df.withColumn(b, bucket).withColumn("_amount", add)
    inside = Window.partitionBy(*group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*group, b).agg(F.sum("_amount").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")))
    own = df.withColumn("_within", F.sum("_amount").over(inside) - F.col("_amount"))
    keys = [*group, b]
    joined = own.alias("o").join(offsets.drop("_n").alias("f"), [F.col(f"o.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys])
    return joined.select(*[F.col(f"o.{c}") for c in df.columns if c not in (b, "_amount")], (F.col("_before") + F.col("_within")).alias(name))
