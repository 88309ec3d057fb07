"""A stored index of what a recording holds around each moment.

One row per recording and time bucket carries the intervals and words that a point in the bucket
can meet up to a horizon, as short sorted arrays. The rows are written once, bucketed and sorted by
recording and time bucket, so points that are dealt by the same two columns join them without an
exchange of the index, and every later query can read it. A recording that holds a third of all
rows spreads over its buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.scalars import BACKCHANNEL_WORDS, is_backchannel_token

from .graphs import shared_folder
from .intervals import bucket


def _around(df: DataFrame, start: Column, end: Column, horizon_s: float) -> DataFrame:
    """One row for each bucket with a point ``t`` such that [t, t + horizon] touches [start, end]."""
    first = bucket(start - horizon_s)
    return df.withColumn("_b", F.explode(F.sequence(first, F.greatest(first, bucket(end)))))


def time_index(intervals: DataFrame, words: DataFrame, horizon_s: float, lexicon: tuple[str, ...] = BACKCHANNEL_WORDS) -> DataFrame:
    """``file_id, _b, intervals, words`` for the buckets that an interval touches.

    ``intervals``: distinct (start_s, seg_idx, end_s), sorted; ``words``: start_s, whether the word
    is ``other`` than the lexicon, and how often that occurs, sorted. Rows without a time are left out.
    """
    iv = _around(intervals.select("file_id", "seg_idx", "start_s", "end_s"), F.col("start_s"), F.col("end_s"), horizon_s)
    said = words.select("file_id", "start_s", (~is_backchannel_token("word", lexicon)).cast("int").alias("other")).groupBy("file_id", "start_s", "other").agg(F.count("*").alias("n"))
    said = _around(said, F.col("start_s"), F.col("start_s"), horizon_s)
    both = iv.select("file_id", "_b", F.struct("start_s", "seg_idx", "end_s").alias("_iv")).unionByName(said.select("file_id", "_b", F.struct("start_s", "other", "n").alias("_w")), allowMissingColumns=True)
    packed = both.groupBy("file_id", "_b").agg(F.array_sort(F.collect_set("_iv")).alias("intervals"), F.array_sort(F.collect_list("_w")).alias("words"))
    return packed.where(F.size("intervals") > 0)


def stored(index: DataFrame, name: str | None = None) -> DataFrame:
    """Write the index as a bucketed, sorted table ``name`` (or one of its own) in the shared folder, and read it."""
    spark = index.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = name or f"time_index_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{table}"
    # the rows of a bucket already meet in one task, where the index was grouped by the same columns
    index.write.mode("overwrite").format("parquet").option("path", path).bucketBy(parts, "file_id", "_b").sortBy("file_id", "_b").saveAsTable(table)
    return spark.table(table)


def at_points(points: DataFrame, index: DataFrame, on: str, t: str, names: dict[str, str], how: str = "inner") -> DataFrame:
    """Points with the arrays of their bucket (``names``: array to column) of the recording in ``on``."""
    side = index.select(F.col("file_id").alias("_file"), F.col("_b").alias("_bucket"), *[F.col(a).alias(c) for a, c in names.items()])
    joined = points.join(side, (F.col(on) == F.col("_file")) & (bucket(F.col(t)) == F.col("_bucket")), how)
    return joined.drop("_file", "_bucket")


def holds(intervals: Column, t: Column) -> Column:
    """Whether one of the intervals contains ``t``, ends included."""
    return F.exists(intervals, lambda v: t.between(v["start_s"], v["end_s"]))


def turn_end(intervals: Column, t: Column) -> Column:
    """The end of the first interval that contains ``t``, or null."""
    return F.get(F.filter(intervals, lambda v: t.between(v["start_s"], v["end_s"])), 0)["end_s"]


def touching(intervals: Column, t: Column, end: Column) -> Column:
    """The intervals that touch [t, end]."""
    return F.filter(intervals, lambda v: (v["start_s"] <= end) & (v["end_s"] >= t))


def voiced_points(points: DataFrame, index: DataFrame, on: str, t: str) -> DataFrame:
    """The points that lie in an interval of their recording, by the index (``intervals.voiced_at`` without one)."""
    return at_points(points, index, on, t, {"intervals": "_iv"}).where(holds(F.col("_iv"), F.col(t))).drop("_iv")


def point_turn_ends(points: DataFrame, index: DataFrame, on: str, t: str) -> DataFrame:
    """Points with ``turn_end``, the end of the first interval (by start) that contains them, or null."""
    return at_points(points, index, on, t, {"intervals": "_iv"}, "left").withColumn("turn_end", turn_end(F.col("_iv"), F.col(t))).drop("_iv")


def utterances_ahead(points: DataFrame, index: DataFrame, on: str, t: str, tau_s: float, with_words: bool = False) -> DataFrame:
    """Points with each interval's part in [t, t + tau] that has a length (``iv_*``, ``c_start``, ``c_end``).

    ``with_words`` adds ``n_words`` and ``n_other``: the words that start in the part, ends
    included. The index must reach ``tau_s``.
    """
    at, end = F.col(t), F.col(t) + tau_s
    both = at_points(points, index, on, t, {"intervals": "_iv", "words": "_words"})
    parts = F.transform(touching(F.col("_iv"), at, end), lambda v: F.struct(v["seg_idx"].alias("iv_seg_idx"), v["start_s"].alias("iv_start_s"), v["end_s"].alias("iv_end_s"), F.greatest(v["start_s"], at).alias("c_start"), F.least(v["end_s"], end).alias("c_end")))
    long = both.withColumn("_p", F.explode(F.filter(parts, lambda p: p["c_start"] < p["c_end"])))
    fields = ["iv_seg_idx", "iv_start_s", "iv_end_s", "c_start", "c_end"]
    flat = long.select(*points.columns, *([] if not with_words else ["_words"]), *[F.col("_p")[f].alias(f) for f in fields])
    if not with_words:
        return flat
    heard = F.filter("_words", lambda w: w["start_s"].between(F.col("c_start"), F.col("c_end")))
    total = lambda f: F.aggregate("_heard", F.lit(0).cast("long"), lambda a, w: a + f(w))
    return flat.withColumn("_heard", heard).withColumns({"n_words": total(lambda w: w["n"]), "n_other": total(lambda w: w["n"] * w["other"])}).drop("_words", "_heard")
