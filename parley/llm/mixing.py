"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

Each source is cut into blocks of about ``BLOCK_BYTES``. Over a period of ``PERIOD`` slots a
source of weight w (whole slots per period) owns w subtasks; subtask k is released at slot
floor(k * PERIOD / w) and due at slot ceil((k + 1) * PERIOD / w). In each slot the released
subtask with the earliest deadline runs. The schedule of one period is a small table, folded by
``aggregate`` in one row; block b of a source then stands in slot
(b div w) * PERIOD + slot(b mod w), and after any number of slots a source with blocks left has
had its share to within less than one block.

All documents are kept: a source that has run out leaves its slots empty, and positions are
gapless over the slots that are filled. Documents stand in a source in the order of a hash of
their id and text, so rows without an id spread as others do. Weights default to the square root of a source's bytes, in whole slots, at least one.

Defined cases: a null source is a source of its own; a null text has no bytes and its row still
has a place; no rows give no rows; ties go to the alphabetically first source; repeated ids get
a place each (only rows that repeat id and text are numbered together); other columns, whatever their names, are ignored. With more than ``PERIOD``/2 sources the period is twice their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.small import few

from .common import numbered, written

PERIOD = 1_000
BLOCK_BYTES = 64_000
#: Bytes of a document besides its text.
OVERHEAD = 8
#: Rows, and slots, that are numbered together.
BUCKET_ROWS = 4_000
BUCKET_SLOTS = 250


def weights_from_bytes(sizes: DataFrame, period: int = PERIOD) -> DataFrame:
    """``source, bytes`` to ``source, weight``: whole slots that sum to ``period``, by largest remainder."""
    root = sizes.select("source", F.sqrt(F.col("bytes").cast("double") + 1).alias("root"))
    every = Window.partitionBy(F.lit(0))
    share = root.withColumn("ideal", F.col("root") / F.sum("root").over(every) * (F.lit(period) - F.count("*").over(every)))
    floor = share.withColumn("whole", F.floor("ideal").cast("long")).withColumn("left", F.lit(period) - F.count("*").over(every) - F.sum("whole").over(every))
    rank = F.row_number().over(every.orderBy(F.desc(F.col("ideal") - F.col("whole")), "source"))
    return floor.withColumn("rank", rank).select("source", (1 + F.col("whole") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("long").alias("weight"))


def schedule(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """``source, weight`` (sum = period) to ``source, weight, k, slot``: one period, earliest deadline first.

    The input is one row per source, at most ``period`` of them, so the fold's one row is bounded.
    """
    one = weights.agg(F.array_sort(F.collect_list(F.struct("source", "weight"))).alias("s"))

    def due(k: Column, w: Column) -> Column:
        return F.ceil((k + 1) * period / w)

    def step(state: Column, t: Column) -> Column:
        # state: done[i] = subtasks of source i that have run; order = sources by slot
        ready = F.transform(
            state["done"],
            lambda k, i: F.when((k < F.get(F.col("s"), i)["weight"]) & (F.floor(k * period / F.get(F.col("s"), i)["weight"]) <= t), F.struct(due(k, F.get(F.col("s"), i)["weight"]).cast("long").alias("due"), i.alias("i"), k.alias("k"))),
        )
        best = F.array_min(F.filter(ready, lambda x: x.isNotNull()))
        return F.struct(
            F.transform(state["done"], lambda k, i: k + F.when(i == best["i"], F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))).alias("done"),
            F.concat(state["order"], F.array(F.struct(best["i"].alias("i"), best["k"].alias("k"), t.alias("slot")))).alias("order"),
        )

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("done"), F.expr("cast(array() as array<struct<i:int,k:bigint,slot:int>>)").alias("order"))
    folded = one.where(F.size("s") > 0).select("s", F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), start, step)["order"].alias("order"))
    return folded.select("s", F.explode("order").alias("o")).select(F.get(F.col("s"), F.col("o.i"))["source"].alias("source"), F.get(F.col("s"), F.col("o.i"))["weight"].alias("weight"), F.col("o.k").alias("k"), F.col("o.slot").cast("long").alias("slot"))


def mix(documents: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text", period: int = PERIOD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, source, weight, block, slot, position`` of every document."""
    out = _mixed(documents, weights, doc_id, source, text, period, block_bytes)
    return out.select("doc_id", "source", "weight", "block", "slot", "position")


def text_mark(text: str) -> Column:
    """What tells rows of one id apart: the MD5 of the text, null as empty."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _mixed(documents: DataFrame, weights: DataFrame | None, doc_id: str, source: str, text: str, period: int, block_bytes: int) -> DataFrame:
    """The columns of ``mix`` and the ``mark`` of the text."""
    marked = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        text_mark(text).alias("mark"),
    )
    rows = written(marked.withColumn("shuffled", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mixing"), "mark").cast("binary"))))
    n = rows.count()
    parts = max(1, -(-n // BUCKET_ROWS) * 2)
    # buckets are ranges of the hash, so that bucket and hash together are one order
    bucket = F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long") * parts / float(1 << 32)
    before = numbered(rows, ["source"], F.floor(bucket).cast("long"), ["shuffled", "doc_id", "size"], "before", F.col("size"))
    blocks = written(before.withColumn("block", F.floor(F.col("before") / block_bytes).cast("long")))
    if weights is None:
        period = max(period, 2 * rows.select("source").distinct().count())
        weights = weights_from_bytes(rows.groupBy("source").agg(F.sum("size").alias("bytes")), period)
    plan = written(schedule(weights, period))
    placed = blocks.alias("b").join(few(plan.select("source", "weight").distinct()).alias("w"), F.col("b.source").eqNullSafe(F.col("w.source"))).select("b.*", "w.weight")
    placed = placed.withColumn("k", F.col("block") % F.col("weight"))
    hit = placed.alias("p").join(few(plan).alias("q"), F.col("p.source").eqNullSafe(F.col("q.source")) & (F.col("p.k") == F.col("q.k"))).select("p.*", (F.floor(F.col("p.block") / F.col("p.weight")) * period + F.col("q.slot")).alias("slot"))
    return _positions(hit)


def _positions(rows: DataFrame) -> DataFrame:
    """Gapless positions by slot, then by place in the source; runs of slots are numbered alone."""
    one = rows.withColumn("_all", F.lit(0))
    return numbered(one, ["_all"], F.floor(F.col("slot") / BUCKET_SLOTS).cast("long"), ["slot", "before", "doc_id"], "position").drop("_all")


def places(documents: DataFrame) -> DataFrame:
    """``placed, mark, position``: each id and text once, with its (first) place in the mixture."""
    out = _mixed(documents, None, "doc_id", "source", "text", PERIOD, BLOCK_BYTES)
    return out.groupBy(F.col("doc_id").alias("placed"), "mark").agg(F.min("position").alias("position"))


def mixed_order(documents: DataFrame) -> DataFrame:
    """All documents with all their columns, in Parquet order of the mixture."""
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), text_mark("text").alias("own"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    joined = rows.join(places(documents), F.col("id").eqNullSafe(F.col("placed")) & (F.col("own") == F.col("mark")), "left")
    return joined.repartitionByRange("position").sortWithinPartitions("position").select("row.*")
