"""The first n rows of every group, without a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import written

#: Spark limits the rows of every task before the shuffle up to this n.
LIMITED = 1_000
#: Ranges of the hash order that are counted.
RANGES_LOG2 = 12


def first_n(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group in ``order`` (with its ``rank`` from 1 if named).

    Up to ``LIMITED`` every task keeps only its own first n rows of a group before the shuffle, and
    what meets in one task is n rows a task. A larger n is found over parts of a group first.
    """
    name = rank or "_rank"
    final = Window.partitionBy(*by).orderBy(*order)
    if n > LIMITED:
        part = Window.partitionBy(*by, "_task").orderBy(*order)
        df = df.withColumn("_task", F.spark_partition_id()).withColumn("_own", F.row_number().over(part)).where(F.col("_own") <= n).drop("_task", "_own")
    kept = df.withColumn(name, F.row_number().over(final)).where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def first_n_by_hash(df: DataFrame, by: Sequence[str], n: int, key: str, seed: int) -> DataFrame:
    """The first ``n`` rows of each group in a seeded hash order, at any n: nothing large is sorted.

    Rows are counted by ranges of the hash. Ranges that end within the first n are kept whole,
    those that start beyond go, and only the range in between is ranked.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    rows = df.withColumn("_h", h).withColumn("_range", F.shiftright("_h", 64 - RANGES_LOG2))
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = written(counts.withColumn("_before", F.sum("_c").over(up) - F.col("_c")).where(F.col("_before") < n))
    match = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "_range"]]
    joined = rows.alias("r").join(needed.alias("c"), match).select("r.*", "c._c", "c._before")
    whole = joined.where(F.col("_before") + F.col("_c") <= n).select(*df.columns)
    cut = Window.partitionBy(*by, "_range").orderBy("_h", key)
    part = joined.where(F.col("_before") + F.col("_c") > n).withColumn("_rank", F.row_number().over(cut)).where(F.col("_rank") <= n - F.col("_before")).select(*df.columns)
    return whole.unionByName(part)
