"""Joins of points and horizons with intervals.

All are equi-joins on the recording and on a time bucket, with the exact condition as residual:
a recording that holds a third of all rows spreads over its buckets, and a pair that shares
several buckets is kept in one of them only. Intervals are closed for points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of a bucket.
BUCKET = 8.0


def bucket(t: Column) -> Column:
    return F.floor(t / BUCKET).cast("long")


def in_buckets(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row per bucket that [start, end] touches, as ``_b``; ``_first`` is the first of them."""
    first = bucket(start)
    return df.withColumn("_first", first).withColumn("_b", F.explode(F.sequence(first, F.greatest(first, bucket(end)))))


def points_in_intervals(points: DataFrame, intervals: DataFrame, on: str, t: str, how: str = "inner", keep: tuple[str, ...] = ("seg_idx", "start_s", "end_s")) -> DataFrame:
    """Points with each interval that contains them. ``on`` names the recording in ``points``."""
    left = points.withColumn("_b", bucket(F.col(t)))
    right = in_buckets(intervals, F.col("start_s"), F.col("end_s")).select(F.col("file_id").alias("_f"), F.col("_b").alias("_rb"), *[F.col(c).alias(f"iv_{c}") for c in ("seg_idx", "start_s", "end_s")])
    joined = left.join(right, (F.col(on) == F.col("_f")) & (F.col("_b") == F.col("_rb")) & F.col(t).between(F.col("iv_start_s"), F.col("iv_end_s")), how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_b")
    drop = [f"iv_{c}" for c in ("seg_idx", "start_s", "end_s") if c not in keep]
    return joined.drop("_f", "_rb", "_b", *drop)


def voiced_at(points: DataFrame, intervals: DataFrame, on: str, t: str) -> DataFrame:
    """The points that lie in an interval of their recording, once each."""
    return points_in_intervals(points, intervals, on, t, "left_semi")


def current_turn_end(points: DataFrame, intervals: DataFrame, on: str, t: str, key: list[str]) -> DataFrame:
    """``key, turn_end``: the end of the first interval (by start) that contains the point, or null."""
    hit = points_in_intervals(points, intervals, on, t, "left")
    first = F.min(F.when(F.col("iv_start_s").isNotNull(), F.struct("iv_start_s", "iv_seg_idx", "iv_end_s")))
    return hit.groupBy(*key).agg(first["iv_end_s"].alias("turn_end"))


def overlapping(horizons: DataFrame, intervals: DataFrame, on: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Horizons [start, end] with each interval that touches them, once each, as ``iv_*``."""
    left = in_buckets(horizons, F.col(start), F.col(end))
    right = in_buckets(intervals, F.col("start_s"), F.col("end_s")).select(F.col("file_id").alias("_f"), F.col("_b").alias("_rb"), F.col("_first").alias("_rfirst"), *[F.col(c).alias(f"iv_{c}") for c in ("seg_idx", "start_s", "end_s")])
    meet = (F.col("iv_start_s") <= F.col(end)) & (F.col("iv_end_s") >= F.col(start))
    once = F.col("_b") == F.greatest("_first", "_rfirst")
    return left.join(right, (F.col(on) == F.col("_f")) & (F.col("_b") == F.col("_rb")) & meet & once, how).drop("_f", "_rb", "_rfirst", "_b", "_first")


def utterances_in_horizon(points: DataFrame, intervals: DataFrame, on: str, t: str, tau_s: Column) -> DataFrame:
    """Each interval's part in [t, t + tau], as ``c_start, c_end``; parts of no length are dropped."""
    h = points.withColumn("_h", F.col(t) + tau_s)
    cut = overlapping(h, intervals, on, t, "_h").withColumn("c_start", F.greatest("iv_start_s", t)).withColumn("c_end", F.least("iv_end_s", "_h"))
    return cut.where("c_start < c_end").drop("_h")


def words_in_utterance(utterances: DataFrame, words: DataFrame, on: str, start: str = "c_start", end: str = "c_end", how: str = "left") -> DataFrame:
    """Words that start within [start, end], both ends closed, as ``w_*``."""
    left = in_buckets(utterances, F.col(start), F.col(end)).drop("_first")
    right = words.withColumn("_wb", bucket(F.col("start_s"))).select(F.col("file_id").alias("_f"), "_wb", *[F.col(c).alias(f"w_{c}") for c in words.columns if c != "file_id"])
    joined = left.join(right, (F.col(on) == F.col("_f")) & (F.col("_b") == F.col("_wb")) & F.col("w_start_s").between(F.col(start), F.col(end)), "inner").drop("_f", "_wb", "_b")
    if how == "inner":
        return joined
    # an utterance without words keeps one row; it may lie in several buckets, so it is added once
    own = utterances.columns
    none = utterances.join(joined.select(*[F.col(c).alias(f"_k_{c}") for c in own]).distinct(), [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in own], "left_anti")
    return joined.unionByName(none, allowMissingColumns=True)
