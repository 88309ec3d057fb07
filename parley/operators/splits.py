"""Leakage-free splits: components of the participant graph packed into train, val and test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dyads import dedupe_prefer
from .filters import exclude_ids
from .graphs import connected_components, written
from .small import few
from .numbering import numbered

SPLITS = ("train", "val", "test")
FRACTIONS = (0.70, 0.15, 0.15)
#: Buckets in which components with text ids are numbered.
TEXT_BUCKETS = 1 << 16


def targets(n: int, fractions: tuple[float, ...] = FRACTIONS) -> list[int]:
    first = [round(f * n) for f in fractions[:-1]]
    return [*first, n - sum(first)]


def take(remaining: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` components of one size each split gets, when every component goes to
    the split with most room left (the first of several). Found without going through them: the
    picks are the largest members of the sequences room - i * size."""
    order = sorted(range(len(remaining)), key=lambda j: -remaining[j])
    given = [0] * len(remaining)
    for k in range(len(order), 0, -1):
        level = (sum(remaining[j] for j in order[:k]) - count * size) / k
        if k == 1 or remaining[order[k - 1]] >= level:
            for j in order[:k]:
                given[j] = max(0, int((remaining[j] - level) // size))
            break
    while sum(given) > count:  # rounding of the level
        j = max((j for j in range(len(given)) if given[j]), key=lambda j: (-(remaining[j] - given[j] * size), j))
        given[j] -= 1
    while sum(given) < count:
        j = max(range(len(given)), key=lambda j: (remaining[j] - given[j] * size, -j))
        given[j] += 1
    return given


def pack_splits(components: DataFrame, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """``component, size`` to ``component, split``: largest first, to the split with most room.

    Components of one size are interchangeable, so only the distinct sizes and their counts
    (their number grows with the square root of the rows at most) reach the driver; within a
    size, components go to the splits in the order of their ids (of a hash of them, if text).
    """
    spark = components.sparkSession
    sizes = components.groupBy("size").agg(F.count("*").alias("m")).orderBy(F.desc("size")).collect()
    room, plan = targets(sum(r["size"] * r["m"] for r in sizes), fractions), []
    for r in sizes:
        given = take(room, r["size"], r["m"])
        start = 0
        for j, n in enumerate(given):
            if n:
                plan.append((r["size"], start, start + n, SPLITS[j]))
            start += n
            room[j] -= n * r["size"]
    table = spark.createDataFrame(plan or [(0, 0, 0, "train")], "s long, first long, last long, split string")
    text = dict(components.dtypes)["component"] == "string"
    bucket = F.pmod(F.xxhash64("component"), F.lit(TEXT_BUCKETS)) if text else F.floor(F.col("component") / 10_000).cast("long")
    ranked = numbered(components, ["size"], bucket, ["component"], "place")
    hit = (F.col("size") == F.col("s")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("last"))
    return ranked.join(few(table), hit).select("component", "split")


def verify_disjoint(manifest: DataFrame) -> DataFrame:
    """Participants that stand in more than one split."""
    people = manifest.select("split", F.explode(F.array("participant_a", "participant_b")).alias("participant"))
    return people.groupBy("participant").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def build_manifest(interactions: DataFrame, excluded: DataFrame | None = None, fractions: tuple[float, ...] = FRACTIONS, preferred: DataFrame | None = None) -> DataFrame:
    """``interaction_id, participant_a, participant_b`` and more, with participant-disjoint splits.

    ``preferred`` is a second pool of the same columns, whose rows win on a shared interaction.
    Participants are long or text ids, put in order within a dyad; dyads count for the size of a
    component. A dyad without any participant is left out.
    """
    pool = interactions if preferred is None else dedupe_prefer(preferred, interactions, "interaction_id")
    pool = pool if excluded is None else exclude_ids(pool, excluded, "interaction_id")
    ordered = pool.withColumn("_a", F.least("participant_a", "participant_b")).withColumn("participant_b", F.greatest("participant_a", "participant_b")).withColumn("participant_a", F.col("_a")).drop("_a")
    comp = connected_components(ordered, "participant_a", "participant_b")
    tagged = written(ordered.join(comp.select(F.col("node").alias("participant_a"), "component"), "participant_a"))
    sizes = tagged.groupBy("component").agg(F.count("*").alias("size"))
    return tagged.join(pack_splits(sizes, fractions), "component")
