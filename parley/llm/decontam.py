"""Benchmark decontamination with suffix arrays over the training shards.

Every Arrow batch of documents is a shard. Its words become integers, its suffixes that could
match anything are sorted into a suffix array to the depth of a window, and every window of the
benchmark is looked up in it by binary search. The documents that are hit, and the items that hit
them, are then sorted to full depth: the neighbours of a suffix in that order give its longest
verbatim match, where it stands and in which item.

Words: A-Z lower-cased, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` (ASCII letters and
digits, and everything beyond ASCII).

Defined cases: a null or empty text has no words and is never hit; an item without words has no
window; an item shorter than a window is one window; repeated items all count; repeated or null
ids are rows like any others; of several longest matches the first in the text counts.
``max_broadcast`` bounds what the driver holds and every task gets: a larger benchmark is searched
in several passes, one after another, whose results are merged by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, slices, written

WINDOW = 10
#: Bytes of benchmark text that one pass sends to every task.
MAX_BROADCAST = 4_000_000
#: Characters of one suffix array.
SHARD_CHARS = 4_000_000

_TO_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Windows:
    """The windows of benchmark items as rows of word numbers, and who owns each."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.width, self.vocabulary = width, {}
        self.sequences: dict[str, list[tuple]] = {}
        by_window: dict[tuple, set] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text))
            self.sequences.setdefault(item, []).append(ids)
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                by_window.setdefault(ids[i : i + width], set()).add(item)
        self.grams = list(by_window)
        self.owners = [sorted(by_window[g]) for g in self.grams]
        self.lengths = np.array([len(g) for g in self.grams], dtype=np.int64)
        self.shortest = int(self.lengths.min()) if len(self.grams) else width
        #: Window prefixes padded with the lowest and the highest word number: both ends of a search.
        low = np.zeros((len(self.grams), width), dtype=np.uint32)
        for i, g in enumerate(self.grams):
            low[i, : len(g)] = g
        high = low.copy()
        high[np.arange(width)[None, :] >= self.lengths[:, None]] = 0xFFFFFFFF
        self.low, self.high = sortable(low), sortable(high)


def sortable(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort alike."""
    if not len(rows):
        return np.zeros(0, dtype=f"S{rows.shape[1] * 4}")
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{rows.shape[1] * 4}").ravel()


class SuffixArray:
    """Sorted suffixes of a shard's word numbers, each to a depth of ``width`` words.

    0 stands for any word that the benchmark lacks and for the end of a document. Suffixes that
    reach it before ``shortest`` words cannot hold a window and are left out.
    """

    def __init__(self, ids: np.ndarray, width: int, shortest: int):
        stop = np.flatnonzero(ids == 0)
        nxt = stop[np.searchsorted(stop, np.arange(len(ids)))] if len(stop) else np.full(len(ids), len(ids))
        run = nxt - np.arange(len(ids))
        at = np.flatnonzero(run >= shortest)
        padded = np.concatenate([ids, np.zeros(width, dtype=ids.dtype)])
        rows = padded[at[:, None] + np.arange(width)[None, :]] * (np.arange(width)[None, :] < run[at][:, None])
        keys = sortable(rows)
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]

    def ranges(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")


def longest_matches(windows: Windows, items: list[str], texts: list[np.ndarray]) -> list[tuple[int, int, str]]:
    """(words, word offset, item) of the longest verbatim match of each text with any of the items.

    All suffixes are sorted by doubling the depth until it covers the longest item.
    """
    owners = [(x, ids) for x in items for ids in windows.sequences[x] if ids]
    parts = [np.array(ids, dtype=np.int64) for _, ids in owners] + [t.astype(np.int64) for t in texts]
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    line = np.concatenate([np.append(p, 0) for p in parts])
    here = np.arange(len(line))
    # what no item has, and the ends, equal nothing
    ranks = [np.unique(np.where(line == 0, len(windows.vocabulary) + 1 + here, line), return_inverse=True)[1]]
    while 1 << (len(ranks) - 1) < max(len(ids) for _, ids in owners):
        step = 1 << (len(ranks) - 1)
        after = np.append(ranks[-1][step:] + 1, np.zeros(min(step, len(line)), dtype=np.int64))
        ranks.append(np.unique(ranks[-1] * (len(line) + 1) + after, return_inverse=True)[1])
    order = np.argsort(ranks[-1], kind="stable")
    test = order < starts[len(owners)]
    place = np.where(test, here, -1)
    before = np.maximum.accumulate(place)
    after = np.minimum.accumulate(np.where(test, here, len(line))[::-1])[::-1]

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = np.zeros(len(a), dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            n += np.where(ranks[k][a + n] == ranks[k][b + n], 1 << k, 0)
        return n

    best, whose = np.zeros(len(line), dtype=np.int64), np.zeros(len(line), dtype=np.int64)
    for near in (before, after):
        at = np.flatnonzero(~test & (near >= 0) & (near < len(line)))
        n = common(order[at], order[near[at]])
        better = n > best[order[at]]
        best[order[at[better]]], whose[order[at[better]]] = n[better], order[near[at[better]]]
    out = []
    for i in range(len(owners), len(parts)):
        at = starts[i] + int(np.argmax(best[starts[i] : starts[i + 1]]))
        out.append((int(best[at]), int(at - starts[i]), owners[int(np.searchsorted(starts, whose[at], "right")) - 1][0]))
    return out


def search_shard(texts: list, windows: Windows, longest: bool = True) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], dict[int, tuple[int, int, str]]]:
    """Words per document, hit words per document, matches (document, word offset, window), and the
    longest match of each document that is hit."""
    split = [words(t) for t in texts]
    count = np.array([len(w) for w in split], dtype=np.int64)
    get, flat = windows.vocabulary.get, []
    for w in split:
        flat.extend([get(x, 0) for x in w])
        flat.append(0)
    ids = np.array(flat, dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum(count + 1)])
    array = SuffixArray(ids, windows.width, windows.shortest)
    lo, hi = array.ranges(windows.low, windows.high)
    found = np.flatnonzero(hi > lo)
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    matches = []
    for w in found:
        at = array.at[lo[w] : hi[w]]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + windows.lengths[w], -1)
        doc = np.searchsorted(starts, at, "right") - 1
        matches += zip(doc.tolist(), (at - starts[doc]).tolist(), [int(w)] * len(at), strict=True)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    best = {}
    if longest and matches:
        hit = sorted({m[0] for m in matches})
        items = sorted({x for w in found for x in windows.owners[w]})
        best = dict(zip(hit, longest_matches(windows, items, [ids[starts[d] : starts[d + 1] - 1] for d in hit]), strict=True))
    return count, covered[starts[1:]] - covered[starts[:-1]], matches, best


def merged(spans: list[tuple[int, int]]) -> int:
    total, end = 0, -1
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


_DDL = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, longest struct<words:long,start:long,item:string>"


def _pass(keyed: DataFrame, windows: Windows) -> DataFrame:
    """``key, doc_id, text`` to ``key, doc_id`` and what the windows hit."""
    held = keyed.sparkSession.sparkContext.broadcast(windows)

    def rows(keys: list, ids: list, texts: list) -> dict:
        out = {"key": keys, "doc_id": ids, "n_words": [], "n_hit": [], "items": [], "spans": [], "longest": []}
        w = held.value
        for a, b in slices(texts, SHARD_CHARS):
            count, hit, matches, best = search_shard(texts[a:b], w)
            items, spans = [set() for _ in range(b - a)], [[] for _ in range(b - a)]
            for d, at, k in matches:
                items[d].update(w.owners[k])
                spans[d].append((at, at + int(w.lengths[k])))
            out["n_words"] += count.tolist()
            out["n_hit"] += hit.tolist()
            out["items"] += [sorted(x) for x in items]
            out["spans"] += [[{"start": s, "end": e} for s, e in sorted(set(x))] for x in spans]
            out["longest"] += [dict(zip(("words", "start", "item"), best[d], strict=True)) if d in best else None for d in range(b - a)]
        return out

    return per_batch(keyed, f"key long, doc_id long, {_DDL}", rows, "key", "doc_id", "text")


def _parts(items: DataFrame, max_broadcast: int, width: int) -> Iterator[tuple[int, Windows]]:
    """The number of parts of the benchmark (``i, t``), and the windows of each; a part is read when it is asked for."""
    size = items.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + F.octet_length("i"))).first()[0] or 0
    n = int(-(-size // max_broadcast)) or 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k) if n > 1 else items
        yield n, Windows([(r.i, r.t) for r in part.toLocalIterator()], width)


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))


def match_benchmark(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", width: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, items, spans`` (word offsets of the matches) and
    ``longest`` (words, start, item; null without a match).

    The benchmark is split by an item hash into as many passes as its checked size needs.
    """
    keyed = documents.select(F.monotonically_increasing_id().alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = None
    for n, windows in _parts(_items(benchmark, item_id, text), max_broadcast, width):
        if n == 1:
            return _pass(keyed, windows).drop("key")
        if every is None:
            keyed = written(keyed)  # all passes see the same keys
        found = written(_pass(keyed, windows))
        every = found if every is None else every.unionByName(found)
    groups = every.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"), F.max(F.when(F.col("longest").isNotNull(), F.struct("longest.words", (-F.col("longest.start")).alias("back"), "longest.item"))).alias("best"))
    longest = F.when(F.col("best").isNotNull(), F.struct("best.words", (-F.col("best.back")).alias("start"), "best.item")).alias("longest")
    merged_rows = groups.select("doc_id", "n_words", "items", "spans", longest)

    def rows(ids: list, count: list, items: list, spans: list, best: list) -> dict:
        own = [sorted({(x["start"], x["end"]) for x in s}) for s in spans]
        return {"doc_id": ids, "n_words": count, "n_hit": [merged(s) for s in own], "items": items, "spans": [[{"start": a, "end": b} for a, b in s] for s in own], "longest": best}

    return per_batch(merged_rows, f"doc_id long, {_DDL}", rows, "doc_id", "n_words", "items", "spans", "longest")


def report(matches: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return matches.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The documents that no window hits, with all their columns; their order is kept within a partition.

    Rows are judged by their own text, so repeated or null ids are harmless.
    """
    kept = documents
    for n, windows in _parts(_items(benchmark, "item_id", "text"), max_broadcast, WINDOW):
        kept = _without_hits(kept, windows)
        kept = written(kept) if n > 1 else kept
    return kept


def _without_hits(documents: DataFrame, windows: Windows) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(windows)
    where = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(where).to_pylist()
            keep = np.ones(len(texts), dtype=bool)
            for a, b in slices(texts, SHARD_CHARS):
                keep[a:b] = search_shard(texts[a:b], held.value, longest=False)[1] == 0
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)
