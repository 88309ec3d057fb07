"""Exact medians of groups of any size, without a group in one task.

``F.median`` keeps all values of a group in one buffer. Here a group of more than ``SMALL``
values is narrowed first: a mergeable quantile summary names two of its values around the median,
exact counts below, at, between and above them say where the median lies, and only those values
go on. Summaries and counts are combined before the shuffle, so a group costs one row a task and
round; a round leaves about one value in a hundred. Groups that are small, or have become so, end in
one bounded buffer each. Summaries only choose where to cut, so the result doesn't depend on
their accuracy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import written

#: Most values that one buffer holds.
SMALL = 10_000
#: Cuts that a summary names, and its accuracy.
CUTS, ACCURACY = 256, 5_000


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _ranks(sizes: DataFrame) -> DataFrame:
    """The ranks whose mean is the median: one for odd sizes, two for even ones."""
    return sizes.withColumn("_k", F.explode(F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))))


def _narrowed(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round over ``keys, _k, _v``: values found as ``keys, _v``, and the rows that are still in question."""
    grid = [i / CUTS for i in range(CUTS + 1)]
    place = F.floor((F.col("_k") + 0.5) / F.col("_n") * CUTS).cast("int")
    cut = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_k").alias("_k"), F.percentile_approx("_v", grid, ACCURACY).alias("_g"))
    cut = cut.select(*keys, F.get("_g", F.greatest(place - 1, F.lit(0))).alias("_lo"), F.get("_g", F.least(place + 2, F.lit(CUTS))).alias("_hi"))
    cut = written(cut)
    joined = rows.alias("r").join(cut.alias("c"), _same("r", "c", keys)).select("r.*", "c._lo", "c._hi")
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    part = F.when(v < lo, 0).when(v == lo, 1).when(v < hi, 2).when(v == hi, 3).otherwise(4)
    counts = [F.sum((part == i).cast("long")).alias(f"_c{i}") for i in range(5)]
    found = joined.groupBy(*keys).agg(F.max("_k").alias("_k"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), *counts)
    before = [sum((F.col(f"_c{j}") for j in range(i)), F.lit(0).cast("long")) for i in range(5)]
    which = F.when(F.col("_k") < before[1], 0).when(F.col("_k") < before[2], 1).when(F.col("_k") < before[3], 2).when(F.col("_k") < before[4], 3).otherwise(4)
    skipped = F.element_at(F.array(*before), F.col("_part") + 1)
    state = written(found.withColumn("_part", which).withColumn("_next", F.col("_k") - skipped))
    done = state.where("_part IN (1, 3)").select(*keys, F.when(F.col("_part") == 1, F.col("_lo")).otherwise(F.col("_hi")).alias("_v"))
    left = joined.withColumn("_own", part).alias("r").join(state.where("_part IN (0, 2, 4)").alias("s"), _same("r", "s", keys) & (F.col("r._own") == F.col("s._part")))
    return done, left.select(*[f"r.{k}" for k in keys], F.col("s._next").alias("_k"), "r._v")


def _large(long: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _median`` of the groups in ``sizes``, by rounds."""
    targets = _ranks(sizes).withColumn("_rank", F.col("_k"))
    inner = [*keys, "_rank"]
    rows = written(long.alias("l").join(targets.alias("t"), _same("l", "t", keys)).select("l.*", "t._rank", "t._k"))
    values = None
    while True:
        ended = written(rows.groupBy(*inner).agg(F.count("*").alias("_n"), F.max("_k").alias("_k")))
        small = ended.where(F.col("_n") <= SMALL)
        bounded = rows.drop("_k").alias("r").join(small.alias("s"), _same("r", "s", inner)).select("r.*", "s._k")
        here = bounded.groupBy(*inner).agg(F.max("_k").alias("_k"), F.sort_array(F.collect_list("_v")).alias("_a")).select(*inner, F.get("_a", F.col("_k").cast("int")).alias("_v"))
        values = here if values is None else values.unionByName(here)
        if not ended.where(F.col("_n") > SMALL).limit(1).count():
            return values.groupBy(*keys).agg(F.avg("_v").alias("_median"))
        big = rows.alias("r").join(ended.where(F.col("_n") > SMALL).select(*inner).alias("s"), _same("r", "s", inner)).select("r.*")
        done, left = _narrowed(big, inner)
        values = values.unionByName(done)
        rows = written(left)


def medians(rows: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """``by`` and, for each ``output: column``, the exact median of its values; null without any.

    As ``F.median``: nulls are left out, NaN is above all, an even number gives the mean of the
    middle two. ``rows`` is read several times, so it should be stored. Without ``by`` there is one row.
    """
    names = sorted(set(columns.values()))
    at = {c: i for i, c in enumerate(names)}
    counts = rows.groupBy(*by).agg(*[F.count(c).alias(f"_n{i}") for c, i in at.items()])
    over = reduce(lambda a, b: a | b, [F.col(f"_n{i}") > SMALL for i in at.values()])
    large = counts.where(over)
    if not large.limit(1).count():
        return rows.groupBy(*by).agg(*[F.median(c).alias(o) for o, c in columns.items()])
    large = written(large)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for c, i in at.items()]))
    sizes = large.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"_n{i}").alias("_n")) for i in at.values()])).alias("x")).select(*by, "x.*").where("_n > 0")
    if by:
        mine = rows.alias("r").join(large.select(*by).alias("s"), _same("r", "s", by), "left_semi").select("r.*")
        rest = rows.alias("r").join(large.select(*by).alias("s"), _same("r", "s", by), "left_anti").select("r.*")
    else:
        mine, rest = rows, None
    long = mine.select(*by, cells.alias("x")).select(*by, "x.*").where(F.col("_v").isNotNull())
    found = _large(long, sizes, [*by, "_c"])
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("_c") == at[c], F.col("_median"))).alias(o) for o, c in columns.items()])
    return wide if rest is None else wide.unionByName(rest.groupBy(*by).agg(*[F.median(c).alias(o) for o, c in columns.items()]))


def with_medians(aggregated: DataFrame, rows: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """``aggregated`` (one row for each value of ``by``) with exact medians of ``rows`` as further columns."""
    found = medians(rows, by, columns)
    if not by:
        return aggregated.join(found)
    joined = aggregated.alias("a").join(found.alias("m"), _same("a", "m", by), "left")
    return joined.select("a.*", *[f"m.{o}" for o in columns])
