"""Ranked lexical search over posting lists in geometric blocks.

Documents become sparse vectors of whole-number impacts. A segment is a bounded run of them with
an index of its own: the posting list of a term is clustered by the similarity of its documents
(each goes to the nearest of evenly taken pivots, by random projections of the vectors), and a
block stores the largest impact of any of its documents in every coordinate. The product of that
summary with a query can't be less than any score in the block, so a block is skipped only if it
is below the score that a document must reach; all others are scored whole.

A query walks its lists from the heaviest term on. A document is met in the list of its first
term, so a later list's summaries count without the terms before it, and lists end where even the
segment's largest impacts can't reach the score. That score is the k-th best so far, at first
from a look at some documents; it only ever spares work. Segments are searched in the tasks that
hold them, each gives at most k documents a query, and the best are merged.

The index is cut to the terms that a batch of queries can ask for; batches are bounded by the
bytes of their texts, and each reads the documents once.

Defined cases: null or empty texts have no terms, and are neither counted nor found; an item
without a term that some document holds gets no rows; each row of the items is ranked by itself,
so repeated and null ids are; repeated documents count and rank each, null ids after all others
of equal score; very long texts are one vector; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_batch, written

#: Separators become blanks, A-Z small letters; bytes beyond ASCII are parts of terms.
_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Documents returned for an item.
TOP = 20
#: Bytes of the items that are searched for in one pass.
BATCH_BYTES = 8 << 20
#: Vector entries of a segment, documents of a block on average, random projections.
SEGMENT, BLOCK, PROJECTIONS = 1 << 18, 32, 16
#: One of so many documents is looked at first, for a score to begin with.
LOOK = 16


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Queries:
    """The items of a batch: terms numbered, and of each item the numbers with their repeats."""

    def __init__(self, texts: list[str | None]):
        counts = [Counter(terms(t)) for t in texts]
        self.numbers = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        self.items = [(np.array([self.numbers[t] for t in c], dtype=np.int64), np.array(list(c.values()), dtype=np.int64)) for c in counts]

    def weighted(self, weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per item the terms that weigh anything, heaviest (rarest) first, and their weights times repeats."""
        out = []
        for at, repeats in self.items:
            order = np.lexsort((at, -weight[at]))
            order = order[weight[at[order]] > 0]
            out.append((at[order], (weight[at] * repeats)[order]))
        return out


def forward(documents: DataFrame, numbers, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with a term: its length, and the batch's terms in it."""

    def rows(ids: list, texts: list) -> dict:
        out: dict[str, list] = {"doc_id": [], "n": [], "terms": [], "tfs": []}
        known = numbers.value
        for i, t in zip(ids, texts, strict=True):
            found = terms(t)
            if found:
                own = sorted((known[w], c) for w, c in Counter(found).items() if w in known)
                out["doc_id"].append(i)
                out["n"].append(len(found))
                out["terms"].append([a for a, _ in own])
                out["tfs"].append([c for _, c in own])
        return out

    plain = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return per_batch(plain, "doc_id long, n long, terms array<int>, tfs array<int>", rows, "doc_id", "text")


class Found:
    """The best documents of one query so far, and the score that the next one must reach."""

    __slots__ = ("k", "least", "score", "place", "row")

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(1, least)
        self.score, self.place, self.row = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, score: np.ndarray, place: np.ndarray, row: np.ndarray) -> None:
        """``place`` orders equal scores; ``row`` says which document it is."""
        keep = score >= self.least
        if keep.any():
            score, place, row = np.concatenate([self.score, score[keep]]), np.concatenate([self.place, place[keep]]), np.concatenate([self.row, row[keep]])
            best = np.lexsort((place, -score))[: self.k]
            self.score, self.place, self.row = score[best], place[best], row[best]
            if len(best) == self.k:
                self.least = max(self.least, int(self.score[-1]))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


class Segment:
    """Vectors of a run of documents, and posting lists in blocks, made when a query walks them."""

    def __init__(self, ptr: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int, directions: np.ndarray):
        self.ptr, self.term, self.impact, self.size, self.directions = ptr, term, impact, size, directions
        rows = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        order = np.argsort(term, kind="stable")
        self.holders, self.first = rows[order], np.searchsorted(term[order], np.arange(size + 1))
        self.most = np.zeros(size, dtype=np.int64)
        np.maximum.at(self.most, term, impact)
        sketch = np.add.reduceat(directions[term] * impact[:, None].astype(np.float32), ptr[:-1], axis=0) if len(term) else np.zeros((0, PROJECTIONS), dtype=np.float32)
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        self.lists: dict[int, tuple] = {}

    def blocks(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the list of ``t``: documents by block, starts of blocks, starts of summaries, their coordinates and maxima."""
        if t not in self.lists:
            rows = self.holders[self.first[t] : self.first[t + 1]]
            count = -(-len(rows) // BLOCK)
            block = np.zeros(len(rows), dtype=np.int64)
            if count > 1:
                pivots = rows[(np.arange(count) * len(rows)) // count]
                block = np.unique(np.argmax(self.sketch[rows] @ self.sketch[pivots].T, axis=1), return_inverse=True)[1]
                order = np.argsort(block, kind="stable")
                rows, block = rows[order], block[order]
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            lengths = self.ptr[rows + 1] - self.ptr[rows]
            at = ranges(self.ptr[rows], lengths)
            key = np.repeat(block, lengths) * self.size + self.term[at]
            order = np.argsort(key, kind="stable")
            key = key[order]
            cut = np.flatnonzero(np.diff(key, prepend=-1))
            maxima = np.maximum.reduceat(self.impact[at][order], cut).astype(np.int32)
            key = key[cut]
            self.lists[t] = rows, np.append(starts, len(rows)), np.searchsorted(key // self.size, np.arange(len(starts))), (key % self.size).astype(np.int32), maxima
        return self.lists[t]

    def search(self, at: np.ndarray, weight: np.ndarray, found: Found, place: np.ndarray, row: np.ndarray, buffers: tuple[np.ndarray, np.ndarray]) -> None:
        """Walk the lists of one query (``at`` heaviest first) and put what it finds into ``found``."""
        full, rest = buffers
        full[at] = rest[at] = weight
        reach = np.cumsum((weight * self.most[at])[::-1])[::-1]
        seen = np.zeros(len(self.ptr) - 1, dtype=bool)
        for j, t in enumerate(at):
            if reach[j] < found.least:
                break
            if self.first[t] < self.first[t + 1]:
                rows, starts, summary, terms_, maxima = self.blocks(int(t))
                bound = np.add.reduceat(rest[terms_] * maxima, summary)
                order = np.argsort(-bound, kind="stable")
                taken, step = 0, 2
                while taken < len(order):
                    some = order[taken : taken + step]
                    some = some[bound[some] >= found.least]
                    if not len(some):
                        break
                    new = rows[ranges(starts[some], starts[some + 1] - starts[some])]
                    new = new[~seen[new]]
                    if len(new):
                        seen[new] = True
                        lengths = self.ptr[new + 1] - self.ptr[new]
                        own = ranges(self.ptr[new], lengths)
                        score = np.add.reduceat(full[self.term[own]] * self.impact[own], np.cumsum(lengths) - lengths)
                        found.add(score, place[new], row[new])
                    taken, step = taken + step, step * 2
            rest[t] = 0
        full[at] = rest[at] = 0


def directions(size: int) -> np.ndarray:
    return np.random.default_rng(12).standard_normal((size, PROJECTIONS)).astype(np.float32)


def best_in_tasks(vectors: DataFrame, plan, k: int) -> DataFrame:
    """``q, doc_id, score``: at most ``k`` documents of each query from each task.

    ``plan``: broadcast dict of ``queries``, ``least`` (score to reach, per query), ``size``,
    ``norm`` (number and length of all documents).
    """
    schema = "q int, doc_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        size, (count, total) = p["size"], p["norm"]
        turn = directions(size)
        found = [Found(k, least) for least in p["least"]]
        buffers = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        ids: list[list] = []
        done = 0

        def segment(parts: list[tuple]) -> None:
            nonlocal done
            own = [i for x in parts for i in x[0]]
            lengths = np.concatenate([x[2] for x in parts])
            n = np.concatenate([x[1] for x in parts])
            term = np.concatenate([x[3] for x in parts]).astype(np.int64)
            tf = np.concatenate([x[4] for x in parts]).astype(np.int64)
            m = 75 + (25 * n * count) // total
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, lengths))
            index = Segment(np.append(0, np.cumsum(lengths)), term, impact, size, turn)
            place = np.array([2**63 - 1 if i is None else i for i in own], dtype=np.int64)
            row = np.arange(done, done + len(own), dtype=np.int64)
            ids.append(own)
            for (at, weight), f in zip(p["queries"], found, strict=True):
                if len(at):
                    index.search(at, weight, f, place, row, buffers)
            # only ids that are still among the best are kept
            alive = np.unique(np.concatenate([f.row for f in found])) if found else np.zeros(0, dtype=np.int64)
            flat = np.array([i for x in ids for i in x], dtype=object)
            ids[:] = [list(flat[alive])]
            for f in found:
                f.row = np.searchsorted(alive, f.row)
            done = len(alive)

        parts: list[tuple] = []
        entries = 0
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            term, tf = batch.column(2).flatten().to_numpy(zero_copy_only=False), batch.column(3).flatten().to_numpy(zero_copy_only=False)
            own, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            ends = np.cumsum(lengths)
            a = 0
            while a < len(own):
                before = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, before + SEGMENT - entries, side="right")))
                parts.append((own[a:b], n[a:b], lengths[a:b], term[before : ends[b - 1]], tf[before : ends[b - 1]]))
                entries += int(ends[b - 1] - before)
                a = b
                if entries >= SEGMENT or a < len(own):
                    segment(parts)
                    parts, entries = [], 0
        if parts:
            segment(parts)
        flat = [i for x in ids for i in x]
        for q, f in enumerate(found):
            if len(f.row):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f.row), q, dtype=np.int32)), pa.array([flat[r] for r in f.row], pa.int64()), pa.array(f.score)], names=["q", "doc_id", "score"])

    return vectors.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs").mapInArrow(run, schema)


def merged(best: DataFrame, k: int) -> DataFrame:
    """``q, rank, doc_id, score``: the ``k`` best of each query; Spark limits every task's rows before the shuffle."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def batches(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple]]:
    """Items as lists of at most ``most`` bytes (one item at least); the driver holds one list at a time."""
    part, size = [], 0
    for r in items.select(F.col(item_id), F.col(text)).toLocalIterator():
        n = len((r[1] or "").encode("utf-8", "surrogatepass")) + 64
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += n
    if part:
        yield part


def search_batch(spark: SparkSession, documents: DataFrame, texts: list[str | None], k: int = TOP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``q, rank, doc_id, score`` for the texts, numbered from 0."""
    queries = Queries(texts)
    numbers = spark.sparkContext.broadcast(queries.numbers)
    vectors = written(forward(documents, numbers, doc_id, text))
    total = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    size = len(queries.numbers)
    weight = np.zeros(max(1, size), dtype=np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weight[r.t] = math.floor(1000 * math.log((2 * total.n + 2) / (2 * r["count"] + 1)))
    plan = {"queries": queries.weighted(weight), "size": size, "norm": (total.n, total.l or 1), "least": [0] * len(texts)}
    # any documents' k-th best score is a score that the k best of all reach
    look = vectors.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(LOOK)) == 0)
    first = merged(best_in_tasks(look, spark.sparkContext.broadcast(plan), k), k).where(F.col("rank") == k).select("q", "score").collect()
    for r in first:
        plan["least"][r.q] = r.score
    return merged(best_in_tasks(vectors, spark.sparkContext.broadcast(plan), k), k)


def search(documents: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of every item."""
    spark = documents.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    out = None
    for part in batches(items, item_id, item_text, BATCH_BYTES):
        found = search_batch(spark, documents, [t for _, t in part], k, doc_id, text)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(part)], f"item int, item_id {kind}")
        joined = found.join(names, F.col("q") == F.col("item")).select("item_id", "rank", "doc_id", "score")
        out = joined if out is None else written(out).unionByName(written(joined))
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return search(documents, items).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
