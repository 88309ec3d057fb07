"""Balanced shards by Karmarkar-Karp differencing.

Groups of equal texts stay together. A partial partition is a row of ``ways`` sums; the two with
the largest spread are combined again and again, one in descending and the other in ascending
order, until one is left.

Differencing is one sequence of steps, so it gets a bounded number of items. Up to ``TOP`` groups
are items themselves. Beyond, groups are bundled by hash at several scales: fifteen sixteenths of
them into ``TOP``/8 large bundles, fifteen sixteenths of the rest into as many bundles a sixteenth
as large, and so on until the rest is few enough to be items; the small ones fill what the large
ones leave uneven. Bundling is a plain sum by key. Groups over 4/``TOP`` of all bytes, a quarter of
``TOP`` at most, are items always. Some ten thousand (id, size) pairs reach the differencing task,
whatever the corpus.

Defined cases: a null text has no bytes and goes with the empty texts; no rows give no rows; a
group larger than a shard's fair share makes that shard larger (groups are never cut) and the
others stay equal; repeated ids get a slot each; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

SHARDS = 24
#: Bytes of a document besides its text.
OVERHEAD = 8
#: Groups that are differenced one by one, and the factor between scales of bundles.
TOP, SCALE = 16_384, 16
#: Rows that are numbered together.
SLOT_ROWS = 50_000


def difference(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The part (0 to ways-1, largest sum first) of each item, by differencing.

    Ties are broken by the order of the items, so equal inputs give equal results.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    sums: list[np.ndarray | None] = []
    heap = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        row = np.zeros(ways, dtype=np.int64)
        row[0] = sizes[i]
        heap.append((-int(sizes[i]), len(sums), i))
        sums.append(row)
    leaves = [x[2] for x in heap]
    heap = [(x[0], x[1]) for x in heap]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable").astype(np.int16)
        total = total[order]
        sums[a] = sums[b] = None
        merges.append((a, b, order))
        sums.append(total)
        heapq.heappush(heap, (int(total[-1] - total[0]), len(sums) - 1))
    labels: dict[int, np.ndarray] = {heap[0][1]: np.arange(ways)}
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        own = labels.pop(n + k)
        into = np.empty(ways, dtype=np.int64)
        into[order] = own
        labels[a], labels[b] = into, into[::-1]
    out = np.empty(n, dtype=np.int64)
    for node, i in enumerate(leaves):
        out[i] = labels[node][0]
    return out


def bundled(groups: DataFrame, n: int, total: int, top: int = TOP) -> DataFrame:
    """``item, size`` with the ``bundle`` that each group takes part in the differencing with."""
    alone = F.concat(F.lit("i:"), "item")
    if n <= top:
        return groups.withColumn("bundle", alone)
    most = max(1, top // 8)
    scales = math.ceil(math.log(n / most) / math.log(SCALE))
    chance = (F.pmod(F.xxhash64("item"), F.lit(1 << 50)) + 1) / float(1 << 50)
    scale = F.floor(-F.log(chance) / F.lit(math.log(SCALE)))
    by_hash = F.concat_ws(":", F.lit("b"), scale, F.pmod(F.xxhash64("item", F.lit(1)), F.lit(most)))
    return groups.withColumn("bundle", F.when((F.col("size") > 4 * total // top) | (scale >= scales), alone).otherwise(by_hash))


def assign(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``item string, size long`` (items unique) to ``item, shard int``."""
    total, n = groups.agg(F.sum("size"), F.count("*")).first()
    members = bundled(groups, n, total or 0, TOP)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "bundle"], ascending=[False, True], kind="stable")
        return pd.DataFrame({"bundle": pdf["bundle"], "shard": difference(pdf["size"].to_numpy(dtype=np.int64), shards).astype(np.int32)})

    items = members.groupBy("bundle").agg(F.sum("size").alias("size"))
    placed = written(items.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(solve, "bundle string, shard int"))
    return members.join(F.broadcast(placed), "bundle").select("item", "shard")


def shard(documents: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", places: DataFrame | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document.

    ``places`` (``placed, mark, position``: each id and MD5 of its text once, positions from 0) gives
    the order of the slots in a shard; rows that it lacks come first. Without it a hash of the id and text does, so that rows
    without an id are numbered by many tasks.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.md5(body.cast("binary")).alias("item"),
    )
    rows = written(rows)
    groups = written(rows.groupBy("item").agg(F.sum("size").alias("size")))
    placed = rows.join(assign(groups, shards), "item").select("doc_id", "size", "text_crc32", "shard", "item")
    if places is None:
        n = rows.count()
        bucket, order = F.pmod(F.xxhash64("doc_id", "item"), F.lit(max(1, -(-n // (SLOT_ROWS * shards)) * 2))), ["doc_id", "item"]
    else:
        placed = placed.join(places, F.col("doc_id").eqNullSafe(F.col("placed")) & (F.col("item") == F.col("mark")), "left").withColumn("position", F.coalesce("position", F.lit(-1).cast("long")))
        bucket, order = F.floor(F.col("position") / SLOT_ROWS).cast("long"), ["position", "doc_id", "item"]
    slots = numbered(placed, ["shard"], bucket, order, "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
