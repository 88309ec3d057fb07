"""Near-duplicates by SimHash fingerprints and BK-trees.

A fingerprint sums the XXH64 hashes (seed 42) of three-word shingles bit by bit. Two distinct
fingerprints within ``RADIUS`` differing bits agree in at least two of four 16-bit blocks, so
shards are keyed by two blocks and their values (six keys a fingerprint, none of which is capped).
In a shard the fingerprints form a BK-tree, children keyed by their integer Hamming distance to
the parent; a search follows only edges within the radius. A shard of over ``TREE`` fingerprints
is cut into trees of that size, and each tree is sent to every block of queries of the shard, so
that no task holds more than two of them. Each task returns a spanning forest of its links, not
the pairs, and components follow from those edges.

Defined cases: texts without words have fingerprint zero and link like any other; a text of one
or two words is one shingle; repeated texts and ids share a fingerprint, hence a component; rows
with a null id get the component of their fingerprint, named by the smallest id in it, if any.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from parley.operators.graphs import connected_components

from .common import per_batch, written

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints of one tree.
TREE = 4_096
BLOCKS = 4
#: Shingles whose bits are summed at once.
RUN = 65_536


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    stop = (ends[SHINGLE - 1 :] - 1).tolist()
    start = [0, *ends[: len(words) - SHINGLE].tolist()]
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(start, stop, strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), RUN):
        ones += np.unpackbits(hashes[a : a + RUN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every whole text."""
    plain = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return per_batch(plain, "doc_id long, fp long", lambda ids, texts: {"doc_id": ids, "fp": [signed(fingerprint(t)) for t in texts]}, "doc_id", "text")


class Tree:
    """A BK-tree over fingerprints (rows of 64-bit words); ``children[i]`` maps a distance to a child."""

    def __init__(self, points: np.ndarray):
        self.points, self.children = points, [{} for _ in points]
        work = [np.arange(len(points))] if len(points) else []
        while work:
            own = work.pop()
            root, rest = own[0], own[1:]
            away = distances(points[rest], points[root])
            for d in np.unique(away):
                below = rest[away == d]
                self.children[root][int(d)] = int(below[0])
                work.append(below)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, the queries within the radius of it), for all queries at once."""
        work = [(0, np.arange(len(queries)))] if len(self.points) and len(queries) else []
        while work:
            node, at = work.pop()
            away = distances(queries[at], self.points[node])
            near = at[away <= radius]
            if len(near):
                yield node, near
            for d, child in self.children[node].items():
                go = at[np.abs(away - d) <= radius]
                if len(go):
                    work.append((child, go))


def distances(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to one of them."""
    return np.bitwise_count(points ^ one).sum(axis=1, dtype=np.int16)


def forest(points: np.ndarray, queries: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (index into points then queries, root) of a spanning forest of all links."""
    parent = list(range(len(points) + len(queries)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for node, near in Tree(points).search(queries, radius):
        r = root(node)
        for q in near.tolist():
            s = root(q + len(points))
            if s != r:
                parent[max(r, s)] = r = min(r, s)
    return [(i, r) for i in range(len(parent)) if (r := root(i)) != i]


def _links(radius: int):
    """Over batches (key, i, j, b, fp) sorted by key, i and j, each group whole within the partition."""
    edges = pa.schema([("src", pa.binary()), ("dst", pa.binary())])

    def solve(own: list[tuple]) -> pa.RecordBatch:
        points, queries = [x[4] for x in own if x[3] == x[1]], [x[4] for x in own if x[3] == x[2]]
        both = points + queries
        as_words = lambda x: np.frombuffer(b"".join(x), dtype=np.uint64).reshape(len(x), -1) if x else np.zeros((0, 1), dtype=np.uint64)
        found = [(both[a], both[b]) for a, b in forest(as_words(points), as_words(queries), radius) if both[a] != both[b]]
        return pa.RecordBatch.from_pydict({"src": [a for a, _ in found], "dst": [b for _, b in found]}, schema=edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
        for _, own in groupby(rows, key=lambda x: x[:3]):
            found = solve(list(own))
            if found.num_rows:
                yield found

    return run


def tree_links(keyed: DataFrame, radius: int, tree: int = TREE) -> DataFrame:
    """``src, dst`` edges that connect all fingerprints linked by chains within shards.

    ``keyed``: ``key, fp`` (long, binary of whole 64-bit words), each pair once; a shard is the
    fingerprints of one key, and two of it link within the radius.
    """
    shards = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("trees", F.ceil(F.col("n") / tree).cast("int")).drop("n")
    own = keyed.join(shards, "key").withColumn("b", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    spread = own.select("key", "fp", "b", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("o")).select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "fp")
    dealt = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return dealt.mapInArrow(_links(radius), "src binary, dst binary")


def links(distinct: DataFrame, tree: int = TREE) -> DataFrame:
    """``src, dst`` edges that connect exactly the fingerprints linked by chains of near ones.

    ``distinct``: one column ``fp`` (long), each value once.
    """
    width = 64 // BLOCKS
    block = [F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit((1 << width) - 1)) for k in range(BLOCKS)]
    pairs = [(a, b) for a in range(BLOCKS) for b in range(a + 1, BLOCKS)]
    keys = [F.shiftleft(F.shiftleft(F.lit(n).cast("long"), width).bitwiseOR(block[a]), width).bitwiseOR(block[b]) for n, (a, b) in enumerate(pairs)]
    keyed = distinct.select(F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), F.explode(F.array(*keys)).alias("key"))
    number = lambda c: F.conv(F.hex(c), 16, -10).cast("long").alias(c)
    return tree_links(keyed, RADIUS, tree).select(number("src"), number("dst"))


def _of_prints(prints: DataFrame) -> DataFrame:
    """``own, component, component_id`` of every distinct ``fp`` of (written) rows ``doc_id, fp``."""
    named = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(written(links(named.select("fp"))))
    member = named.join(found, named["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    return member.join(smallest, "component").select(F.col("fp").alias("own"), "component", "component_id")


def components(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every document."""
    prints = written(fingerprints(documents, doc_id, text))
    of = _of_prints(prints)
    return prints.join(of, prints["fp"] == of["own"]).select("doc_id", "fp", "component_id")


def report(documents: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return components(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def numbered_rows(documents: DataFrame) -> DataFrame:
    """``key, id, row``: every row with a key of its own; the row is a struct, so that no column can clash."""
    rows = documents.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    return written(rows)


def first_of_each(rows: DataFrame, placed: DataFrame, group: list[str]) -> DataFrame:
    """The documents of ``rows`` that come first in their group of ``placed`` (``key, id, mark`` and the group).

    First is the smallest id, nulls last, then the smallest mark (a hash of the text), then the key.
    """
    first = placed.groupBy(*group).agg(F.min(F.struct(F.col("id").isNull(), "id", "mark", "key")).alias("first")).select("first.key")
    return rows.join(first, "key", "left_semi").select("row.*")
