"""Near copies: SimHash fingerprints and BK-trees find them, exact similarity decides.

Two texts are near if the Jaccard similarity of their sets of five-word shingles (as 64-bit
hashes) is ``SIMILAR`` or more.

1. A text has a fingerprint of ``BITS`` bits, and ``SHARDS`` shards: the smallest of its shingles in as
   many random orders. Near texts share each of them with a probability of 0.8 or more, so they
   miss each other in all with less than one in 300,000.
2. The fingerprints of a shard form a BK-tree (trees, beyond ``simhash.TREE``), and those within
   ``RADIUS`` differing bits are linked. Near texts differ in about 39 of 256 bits (a standard
   deviation of six; more in very short texts), others in about half.
3. Texts that such links join are searched by breadth: a text is compared, shingle by shingle, with
   those not reached yet, so a large group of copies costs few comparisons a text. Groups of
   over ``BLOCK`` texts or ``WEIGHT`` shingles are cut into blocks, and each pair of blocks is searched alone.
4. Components follow from the exact links.

Texts are known by the 128-bit hash of their lower-cased words. Defined cases: texts without words
are copies of each other; a text of under five words is one shingle; rows of one id or without an
id are rows like any others, told apart by their texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from parley.operators.graphs import connected_components

from . import simhash
from .common import per_batch, written
from .simhash import first_of_each, numbered_rows

SHINGLE = 5
#: The least similarity, as a fraction.
OVER, UNDER = 4, 5
BITS, RADIUS, SHARDS = 256, 80, 8
#: Texts of a block, and shingles (8 bytes each) of a block on average.
BLOCK, WEIGHT = 4_096, 4_000_000
#: Keys of candidates that are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST = 250_000
_MULT = np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes; one at least."""
    size = min(SHINGLE, len(words))
    own = np.fromiter((xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    code = np.full(max(1, len(words) - SHINGLE + 1), size, dtype=np.uint64)
    for k in range(size):
        code = (code ^ own[k : k + len(code)]) * _MULT
        code ^= code >> np.uint64(29)
    return np.unique(code * np.uint64(0x9E3779B97F4A7C15))


def mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """The n-th of a family of hashes of hashes."""
    x = hashes + np.uint64((n + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray) -> bytes:
    """``BITS`` bits, each set if it is in over half of the hashes."""
    words = np.stack([mixed(hashes, n) for n in range(BITS // 64)], axis=1)
    ones = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(hashes), 255):  # sums of so many bits fit in a byte
        ones += np.add.reduce(np.unpackbits(words[a : a + 255].view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def shards(hashes: np.ndarray) -> list[int]:
    """The smallest hash in each of ``SHARDS`` orders."""
    return [int(mixed(hashes, 100 + n).min().view(np.int64)) for n in range(SHARDS)]


def edges(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the near pairs (across the sides, if given), by breadth."""
    sizes = np.array([len(s) for s in sets])
    value, index = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    held = np.zeros(len(value), dtype=bool)
    left, out, work = np.ones(len(sets), dtype=bool), [], []
    for first in range(len(sets)):
        if left[first]:
            left[first] = False
            work.append(first)
        while work:
            i = work.pop()
            at = np.flatnonzero(left & (UNDER * sizes >= OVER * sizes[i]) & (OVER * sizes <= UNDER * sizes[i]))
            if side is not None:
                at = at[side[at] != side[i]]
            if not len(at):
                continue
            held[index[ends[i] : ends[i + 1]]] = True
            common = np.array([np.count_nonzero(held[index[ends[j] : ends[j + 1]]]) for j in at])
            held[index[ends[i] : ends[i + 1]]] = False
            for j in at[UNDER * common >= OVER * (sizes[i] + sizes[at] - common)].tolist():
                left[j] = False
                out.append((i, j))
                work.append(j)
    return out


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block against itself, or two against each other (texts of one block meet in its own task)."""
    sets = [np.asarray(x).view(np.uint64) for x in pdf["hashes"]]
    side = pdf["b"].to_numpy()
    node = pdf["node"].tolist()
    found = edges(sets, None if (side == side[0]).all() else side)
    return pd.DataFrame({"src": [node[a] for a, _ in found], "dst": [node[b] for _, b in found]})


def links(rows: DataFrame, printed: DataFrame, block: int = BLOCK, tree: int = simhash.TREE, weight: int = WEIGHT) -> DataFrame:
    """``src, dst`` edges between the ``node`` of near texts; ``rows`` have ``key, text``, ``printed`` (written) their prints."""
    one = written(printed.groupBy("node").agg(F.min("key").alias("key"), F.min("fp").alias("fp"), F.min("shards").alias("shards"), F.max("n_shingles").alias("n_shingles")))
    keyed = written(one.select("fp", F.explode("shards").alias("key")).distinct())
    found = written(connected_components(written(simhash.tree_links(keyed, RADIUS, tree))))
    placed = one.join(found.withColumnRenamed("node", "own"), F.col("fp") == F.col("own"), "left").select("node", "key", "n_shingles", F.coalesce("component", "fp").alias("component"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w")).where("n > 1").select("component", F.ceil(F.greatest(F.col("n") / block, F.col("w") / weight)).cast("int").alias("cuts"))
    placed = written(placed.join(sizes, "component"))
    asked = placed.select("key")
    asked = F.broadcast(asked) if placed.count() <= BROADCAST else asked

    def whole(keys: list, texts: list) -> dict:
        return {"key": keys, "hashes": [shingles(words_of(t)).view(np.int64) for t in texts]}

    sets = per_batch(rows.select("key", "text").join(asked, "key", "left_semi"), "key long, hashes array<long>", whole, "key", "text")
    cut = sets.join(placed, "key").withColumn("b", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    dealt = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select("component", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "node", "hashes")
    return dealt.groupBy("component", "i", "j").applyInPandas(_search, "src binary, dst binary")


def prints(texts: DataFrame) -> DataFrame:
    """``key, id, mark`` with the ``node, fp, shards, n_shingles`` of each text."""

    def rows(key: list, id_: list, mark: list, text: list) -> dict:
        split = [words_of(t) for t in text]
        sets = [shingles(w) for w in split]
        return {"key": key, "id": id_, "mark": mark, "node": [xxh3_128_digest(b" ".join(w)) for w in split], "fp": [fingerprint(x) for x in sets], "shards": [shards(x) for x in sets], "n_shingles": [len(x) for x in sets]}

    return per_batch(texts, "key long, id long, mark long, node binary, fp binary, shards array<long>, n_shingles int", rows, "key", "id", "mark", "text")


def near_components(rows: DataFrame) -> DataFrame:
    """``key, id, mark, component`` of (written) ``key, id, mark, text``."""
    printed = written(prints(rows))
    found = connected_components(written(links(rows, printed)))
    return printed.join(found.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left").select("key", "id", "mark", F.coalesce("component", "node").alias("component"))


def without_near_copies(documents: DataFrame) -> DataFrame:
    """One document of each component of near copies, with all its columns: the smallest id, nulls last."""
    rows = numbered_rows(documents)
    return first_of_each(rows, near_components(rows.select("key", "id", F.col("row.text").alias("text"), F.xxhash64("row.text").alias("mark"))), ["component"])
