"""Removal of repeated byte strings, by suffix arrays over the places where repeats can be.

A byte is removed if it is covered by a string of ``LENGTH`` bytes that starts at least twice in
the corpus, within documents. Shorter repeats, strings of ``PASSAGE`` bytes (a passage of some
fifty words), are found by the same sort and reported, but stay in the text. The steps:

1. Every window of ``PASSAGE`` bytes has an anchor, its smallest hashed gram of ``GRAM`` bytes, found
   by a sliding minimum. Runs of windows with one anchor form a segment, which carries the bytes
   of the longest string that starts at any of its windows. Equal windows have equal anchors, so
   the segment's key (the gram) brings all equal windows together; keys seen once are dropped.
2. Of each key, one segment of each content is taken (contents seen twice are repeats whole) and
   its bytes are fetched.
3. Segments meet by key; those that share no bytes any equal windows would share go. Those of many keys make up one text whose suffix array is built by
   two-stage sorting: only suffixes smaller than their successors are sorted directly, the others
   are induced by scanning the buckets of first bytes in order. Adjacent common prefixes of
   ``LENGTH`` (``PASSAGE``) bytes mark repeated strings.
4. Keys with over ``HOT`` different segments are not gathered: their strings are counted by hash, and
   all but those that occur once are repeats.
5. Marks go back to every document that holds the segment, which removes the covered bytes.

Defined cases: a null text is empty; texts under ``PASSAGE`` bytes have no repeats; repeated rows
are documents of their own, so they repeat each other; repeated or null ids are told apart by
their text (same id and same text give the same result on each row); very long texts are cut into
pieces that overlap; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import written

LENGTH, PASSAGE = 400, 256
#: Bytes of a gram: three times a power of two.
GRAM = 96
#: Bytes whose anchors are found at once; positions take 24 bits.
PIECE = 100_000
#: Suffixes that are compared with their neighbours at once.
RUN = 16_384
#: Bytes of one suffix array, and segments of a key beyond which its windows are counted by hash.
CHUNK, HOT = 400_000, 2_000
#: Offsets of an anchor that are compared at once before sorting.
STEP = 41
#: Bytes of segments that one task sorts.
SORTED = 4_000_000
_POSITION = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray) -> np.ndarray:
    """For the window at each offset, where its smallest gram starts (the leftmost, if several)."""
    h = data.astype(np.uint64) + np.uint64(1)
    width, base = 1, 0x9E3779B97F4A7C15
    while 3 * width < GRAM:
        h = h[:-width] * np.uint64(base) + h[width:]
        base = base * base % (1 << 64)
        width *= 2
    h = (h[: -2 * width] * np.uint64(base) + h[width:-width]) * np.uint64(base) + h[2 * width :]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h &= ~_POSITION
    h |= np.arange(len(h), dtype=np.uint64)
    span, width = PASSAGE - GRAM + 1, 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < span:
        h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
    return (h & _POSITION).astype(np.int64)


def segments(texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(text, first window, last window, anchor less first window, windows that are ``LENGTH`` long, key,
    content hash) of every segment."""
    pieces: list[tuple[int, int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for a in range(0, len(t) - PASSAGE + 1, PIECE):
            part = t[a : a + PIECE + LENGTH - 1]
            if size + len(part) > PIECE and pieces:
                yield from _segments(pieces)
                pieces, size = [], 0
            pieces.append((i, a, min(PIECE, len(t) - PASSAGE + 1 - a), part))
            size += len(part)
    if pieces:
        yield from _segments(pieces)


def _segments(pieces: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    line = b"".join(p[3] for p in pieces)
    starts = np.cumsum([0, *(len(p[3]) for p in pieces)])
    at = anchors(np.frombuffer(line, dtype=np.uint8))
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    # windows that reach over the end of a text are none, and those of the next piece are its own
    last = starts[:-1] + [p[2] - 1 for p in pieces]
    bounds = np.unique(np.concatenate([[0], cut, starts[:-1], last + 1]))
    bounds = bounds[bounds < len(at)]
    stops = np.append(bounds[1:], len(at))
    owner = np.searchsorted(starts, bounds, "right") - 1
    good = bounds <= last[owner]
    bounds, stops, owner = bounds[good], stops[good], owner[good]
    ends = starts[owner + 1]
    long = np.clip(np.minimum(stops, ends - LENGTH + 1) - bounds, 0, None)
    till = np.minimum(stops - 1 + LENGTH, ends)
    for s, e, o, p, n, z in zip(bounds.tolist(), (stops - 1).tolist(), owner.tolist(), at[bounds].tolist(), long.tolist(), till.tolist(), strict=True):
        i, offset, _, _ = pieces[o]
        offset -= int(starts[o])
        yield i, s + offset, e + offset, p - s, n, xxh3_64_intdigest(line[p : p + GRAM]), xxh3_64_intdigest(line[s:z])


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in order of their first ``depth`` symbols, by two-stage sorting."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16), append=-1))
    # equal neighbours compare as the next unequal ones do
    nonzero = np.flatnonzero(step)
    step = step[nonzero[np.searchsorted(nonzero, np.arange(n))]]
    smaller = step > 0  # smaller than its successor: sorted directly
    direct = np.flatnonzero(smaller)
    padded = np.concatenate([text, np.zeros(depth, dtype=np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")]
    first = text[direct]
    edges = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[int(text[-1])].append(np.array([n - 1]))  # larger than the empty suffix after it
    out = []
    for c in range(256):
        front = np.concatenate(induced[c]) if induced[c] else np.zeros(0, dtype=np.int64)
        waves = [front]
        while len(front):
            front = front[front > 0] - 1
            front = front[(text[front] == c) & ~smaller[front]]
            waves.append(front)
        bucket = np.concatenate([*waves, direct[edges[c] : edges[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & ~smaller[before]]
        if len(before):
            symbol = text[before]
            order = np.argsort(symbol, kind="stable")
            before, symbol = before[order], symbol[order]
            ends = np.flatnonzero(np.diff(symbol)) + 1
            for part in np.split(before, ends):
                induced[int(text[part[0]])].append(part)
    return np.concatenate(out)


def same_as_before(text: np.ndarray, order: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length (a multiple of 8): does a suffix share so many bytes with the one before it in order?"""
    most = max(lengths)
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(most, dtype=np.uint8)]), most)
    out = [np.zeros(len(order), dtype=bool) for _ in lengths]
    for a in range(0, len(order), RUN):
        own = np.ascontiguousarray(rows[order[max(0, a - 1) : a + RUN]]).view(np.uint64)
        alike = own[1:] == own[:-1]
        for x, n in zip(out, lengths, strict=True):
            x[max(1, a) : a + RUN] = alike[:, : n // 8].all(1)
    return out


Ranges = tuple[np.ndarray, np.ndarray]


def repeated_windows(parts: list[bytes], windows: list[int]) -> list[Ranges]:
    """For ``LENGTH`` and ``PASSAGE``: the runs of offsets, among the first ``windows`` of each segment, that
    start a string of that length which starts twice or more in all of them.

    A run is packed as first << 32 | last; the runs of segment i are those from the i-th edge to the next.
    """
    # 0 ends a segment; bytes FF, which UTF-8 lacks, leave room for the shift by one
    line = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8).copy()
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-1]])
    body = np.ones(len(line), dtype=bool)
    body[ends - 1] = False
    line[body] += 1
    order = suffix_array(line, LENGTH)
    owner = np.repeat(np.arange(len(parts)), ends - starts)
    here = np.arange(len(line))
    own = (here < (starts + np.array(windows))[owner]) & (here + PASSAGE < ends[owner])
    order = order[own[order]]
    found = []
    for length, twice in zip((LENGTH, PASSAGE), same_as_before(line, order, (LENGTH, PASSAGE)), strict=True):
        twice[:-1] |= twice[1:].copy()
        # what is alike beyond the end of a segment is no string of it
        twice &= order + length < ends[owner[order]]
        at = np.sort(order[twice])
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        whose = owner[at[first]]
        found.append(((at[first] - starts[whose]) << 32 | (at[last] - starts[whose]), np.searchsorted(whose, np.arange(len(parts) + 1))))
    return found


_RANGE = pa.list_(pa.int64())
_SEGMENTS = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("g", pa.int64()), ("q", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("c", pa.int32()), ("l", pa.int32())])
_SEGMENTS_DDL = "k long, t long, g long, q long, s int, e int, c int, l int"
_RANGES = pa.schema([("g", pa.int64()), ("q", pa.int64()), ("r", _RANGE), ("p", _RANGE)])
_RANGES_DDL = "g long, q long, r array<long>, p array<long>"
_FETCHED = pa.schema([("g", pa.int64()), ("q", pa.int64()), ("n", pa.int32()), ("c", pa.int32()), ("body", pa.binary()), ("o", pa.int32()), ("whole", pa.bool_()), ("w", pa.binary())])
_FETCHED_DDL = "g long, q long, n int, c int, body binary, o int, whole boolean, w binary"


def _all_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
        rows = list(segments(texts))
        if rows:
            i, s, e, c, n, g, q = zip(*rows, strict=True)
            as_long = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array(as_long(g)), pa.array(as_long(q)), *(pa.array(x, pa.int32()) for x in (s, e, c, n))], schema=_SEGMENTS)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted): the bytes of the wanted segments, or the hashes of each window of hot ones."""
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in _FETCHED}

        def add(*values):
            for name, value in zip(out, values, strict=True):  # noqa: B023
                out[name].append(value)  # noqa: B023

        for text, wanted in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            body = (text or "").encode("utf-8", "surrogatepass")
            for x in wanted:
                part, n = body[x["s"] : x["e"] + LENGTH], x["e"] - x["s"] + 1
                if not x["hot"]:
                    add(x["g"], x["q"], n, x["c"], part, None, None, None)
                    continue
                for whole, length in ((True, LENGTH), (False, PASSAGE)):
                    for o in range(min(n, len(part) - length + 1)):
                        add(x["g"], x["q"], n, None, None, o, whole, xxh3_128_digest(part[o : o + length]))
        if out["g"]:
            yield pa.RecordBatch.from_pydict(out, schema=_FETCHED)


def alike(group: list[tuple]) -> list[tuple]:
    """The rows (g, q, n, c, body) of one key that may share a window with another.

    Windows with an anchor ``a`` to ``a + STEP - 1`` bytes behind their start share all bytes from ``a``
    before the anchor up to the end of the last of them; so do equal ones in another segment.
    """
    cores = [[(a, body[c - a : c - a - STEP + 1 + PASSAGE]) for a in range(max(0, c - n + 1) // STEP * STEP, c + 1, STEP)] for _, _, n, c, body in group]
    seen = Counter(x for own in cores for x in own)
    return [row for row, own in zip(group, cores, strict=True) if any(seen[x] > 1 for x in own)]


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, q, n, c, body) sorted by g and q; groups are whole within the partition."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        ranges = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(runs, pa.int64())) for runs, edge in repeated_windows([x[4] for x in rows], [x[2] for x in rows])]
        found = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), *ranges], schema=_RANGES)
        return found.filter(pc.greater(pc.list_value_length(found.column(3)), 0))

    held: list[tuple] = []
    group: list[tuple] = []
    size = 0
    for row in chain((row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)), [None]):
        if group and row and row[:2] == group[-1][:2]:
            continue
        if group and (row is None or row[0] != group[-1][0]):
            group = alike(group)
            held += group
            size += sum(len(x[4]) for x in group)
            group = []
            if held and (row is None or size >= CHUNK):
                yield solve(held)
                held, size = [], 0
        group.append(row)


def runs_of(spans: list[int]) -> list[list[int]]:
    """The maximal runs that spans (packed as first << 32 | end) cover."""
    runs: list[list[int]] = []
    for x in sorted(spans):
        a, b = x >> 32, x & 0xFFFFFFFF
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def remaining(body: bytes, spans: list[int]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and what is left."""
    runs, kept, at = runs_of(spans), [], 0
    for a, b in runs:
        kept.append(body[at:a])
        at = b
    kept.append(body[at:])
    return sum(b - a for a, b in runs), len(runs), b"".join(kept)


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string()), ("n_repeated", pa.int64())])
_CUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, n_repeated long"


def repeated_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``k, t, spans, passages`` per key of an id and hash of a text: the byte ranges
    (first << 32 | end) that repeated strings of ``LENGTH`` cover, and those of ``PASSAGE``."""
    rows = _keyed(documents, doc_id, text)
    found = written(rows.select("k", "t", "text").mapInArrow(_all_segments, _SEGMENTS_DDL))
    # small tables are written before they are joined: a join of plain scans can split a hot key
    again = written(found.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select(F.col("g").alias("g2")))
    shared = written(found.join(again, F.col("g") == F.col("g2"), "left_semi"))
    contents = written(shared.groupBy("g", "q").agg(F.count("*").alias("n"), F.min(F.struct("k", "t", "s", "e", "c", "l")).alias("one")))
    several = written(contents.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select(F.col("g").alias("g2"), (F.col("m") > hot).alias("hot")))
    wanted = contents.join(several, F.col("g") == F.col("g2")).select("one.*", "g", "q", "hot").groupBy("k", "t").agg(F.collect_list(F.struct("g", "q", "s", "e", "c", "hot")).alias("wanted"))
    fetched = written(rows.join(wanted, ["k", "t"]).select("text", "wanted").mapInArrow(_fetch, _FETCHED_DDL))
    bodies = fetched.where("body is not null").select("g", "q", "n", "c", "body")
    tasks = int(-(-(bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // SORTED)) or 1
    sorted_out = bodies.repartition(tasks, "g").sortWithinPartitions("g", "q").mapInArrow(_sort, _RANGES_DDL)
    windows = fetched.where("body is null").select("g", "q", "o", "whole", "w")
    once = windows.groupBy("g", "whole", "w").agg(F.count("*").alias("n"), F.min("q").alias("q"), F.min("o").alias("o")).where("n = 1")
    single = once.groupBy(F.col("g").alias("g1"), F.col("q").alias("q1")).agg(F.collect_list(F.when(F.col("whole"), F.col("o"))).alias("r1"), F.collect_list(F.when(~F.col("whole"), F.col("o"))).alias("p1"))
    hottest = contents.join(several.where("hot"), F.col("g") == F.col("g2")).select("g", "q", "one").join(single, (F.col("g") == F.col("g1")) & (F.col("q") == F.col("q1")), "left")
    none = F.array().cast("array<int>")
    packed = F.lit(1 << 32)
    other = lambda n, c: F.transform(F.array_except(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none), F.coalesce(c, none)), lambda x: x * packed + x)
    counted = hottest.select("g", "q", other(F.col("one.l"), F.col("r1")).alias("r"), other(F.col("one.e") - F.col("one.s") + 1, F.col("p1")).alias("p"))
    run = lambda n: F.when(n > 0, F.array((n - 1).cast("long"))).otherwise(F.array().cast("array<long>"))
    repeats = contents.where("n > 1").select("g", "q", run(F.col("one.l")).alias("r"), run(F.col("one.e") - F.col("one.s") + 1).alias("p"))
    marks = repeats.unionByName(written(sorted_out)).unionByName(counted).select(F.col("g").alias("g2"), F.col("q").alias("q2"), "r", "p")
    placed = lambda c, length: F.transform(c, lambda x: x + F.col("s") * F.lit((1 << 32) + 1) + F.lit(length)).alias(c)
    # rows of one id and text mark the same places: each place once, however many such rows there are
    places = shared.select("k", "t", "g", "q", "s").distinct()
    marked = places.join(marks, (F.col("g") == F.col("g2")) & (F.col("q") == F.col("q2"))).select("k", "t", placed("r", LENGTH), placed("p", PASSAGE))
    return marked.groupBy("k", "t").agg(F.flatten(F.collect_list("r")).alias("spans"), F.flatten(F.collect_list("p")).alias("passages"))


def _keyed(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows meet their own results by id and hash of the text, so that neither null nor repeated ids gather.

    Rows with both the same share their results. A null id takes the hash's place too.
    """
    id_, mark = F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return documents.select(id_.alias("doc_id"), F.coalesce(id_, mark).alias("k"), mark.alias("t"), F.col(text).alias("text"))


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, with_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256, n_repeated`` of every row (kept only if asked for).

    ``n_repeated``: the bytes that strings of ``PASSAGE`` bytes cover which also start elsewhere.
    """
    spans = repeated_spans(documents, doc_id, text, hot)
    joined = _keyed(documents, doc_id, text).join(spans, ["k", "t"], "left").select("doc_id", "text", "spans", "passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _CUT}
            for id_, text_, spans_, passages in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                body = (text_ or "").encode("utf-8", "surrogatepass")
                n, runs, kept = remaining(body, spans_ or [])
                repeated = sum(b - a for a, b in runs_of(passages or []))
                for name, value in zip(out, (id_, len(body), n, runs, kept if with_bytes else None, hashlib.sha256(kept).hexdigest(), repeated), strict=True):
                    out[name].append(value)
            if out["doc_id"]:
                yield pa.RecordBatch.from_pydict(out, schema=_CUT)

    return joined.mapInArrow(run, _CUT_DDL)


def report(documents: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return remove_repeats(documents, with_bytes=False).drop("kept")
