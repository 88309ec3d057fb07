"""A hashed maximum-entropy language model with a class-factored softmax, and the base score.

Tokens: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, then one end token a text. The steps:

1. Documents are dealt by a hash of id and text, into partitions that the bytes of the corpus
   alone determine, and become packs: local word numbers of every token, and the pack's distinct
   words as 64-bit hashes with their counts in training texts. A pack is written once.
2. The packs' distinct words go to count shards by hash. A shard adds up the counts and answers
   each pack with the totals of the words it asked for. So counts cover the whole corpus, and no
   task holds more than a shard or a pack. A pack sends a row to the shards it has words for alone.
3. Every word has a leaf of a tree of ``WAYS`` ** 3 leaves, P(leaf) = P(class | context) * P(second
   class | class, context) * P(leaf | both, context), each a softmax of ``WAYS`` outcomes. The
   ``FREQUENT`` most frequent words have leaves of their own; all others are hashed to the other
   leaves, whose classes follow from a word's last bytes. Features are the four words before
   (single, hence with skips) and the hashed pair of the last two, hashed with the classes above.
   A shared leaf spreads over its words by add-one smoothed corpus counts.
4. Training starts from the unigrams of the tree and passes once over all training packs, a part of
   them in each of ``ROUNDS`` rounds. In a round, AdaGrad steps over each pack start from the same
   weights; the changes are averaged in Spark, each row weighted by the tokens that moved it, in
   two levels and slice by slice, and the (bounded) weights go out again.
5. Packs meet the answers of step 2 and are scored in numpy batches.

Defined cases: a null text is empty and has the end token alone; without training tokens N = V =
0 and every word is unknown; repeated rows are scored and counted each; a null id counts as the
empty text when folds are dealt; very long texts are one text of a pack; an empty table gives no rows;
other columns, whatever their names, are ignored. Two words with one 64-bit hash would share a count.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import written

FOLDS, HELD_OUT = 7, 2
#: Outcomes of each softmax, levels of the tree, words with a leaf of their own.
WAYS, LEVELS, FREQUENT = 16, 3, 1_024
LEAVES = WAYS**LEVELS
#: Second classes that shared leaves have.
SHARED = (LEAVES - FREQUENT) // WAYS
CONTEXT = 4
#: Features of each level (0 to 3: the word so many and one back; 4: the last two), and rows of a table.
FEATURES = ((0, 1, 2, 3, 4), (0, 1, 4), (0, 4))
ROWS = 1 << 14
ROUNDS, RATE = 4, 0.15
#: Tokens of a gradient step, and tokens that are scored at once.
STEP, BATCH = 8_192, 4_096
#: Packs whose changes a training task adds up.
TASK_PACKS = 4
#: Rows that are averaged together, and tasks whose changes meet in one place before the last sum.
SLICE, FAN_IN = 8_192, 64
#: Bytes of text of a partition, characters of a pack, entries of a count shard.
PART, PACK, SHARD = 16_000_000, 16_000_000, 1_000_000
END = xxh3_64_intdigest(b"")  # no word is empty

_PACKS = pa.schema([("pack", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary()), ("leaves", pa.binary()), ("counts", pa.binary()), ("n_words", pa.int64()), ("n_train", pa.int64())])
_PACK_DDL = "pack long, ids array<long>, lengths binary, tokens binary, words binary, leaves binary, counts binary, n_words long, n_train long"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def shared_leaf(word: bytes, code: int) -> int:
    """The leaf of a word that has none of its own: classes by its last two bytes, then by its hash."""
    last = word[-2:]
    return FREQUENT + ((last[-1] * 31 + last[0]) % (SHARED // 2) * 2 + word.isascii()) * WAYS + code % WAYS


class _Numbers(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def _pack(number: int, ids: list, texts: list) -> dict:
    numbers = _Numbers({b"": 0})
    tokens, lengths = [], []
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        tokens += map(numbers.__getitem__, words)
        tokens.append(0)
        lengths.append(len(words) + 1)
    flat, size = np.array(tokens, dtype=np.uint32), np.array(lengths, dtype=np.uint32)
    # frequent words get small numbers, which compress well
    order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
    place = np.empty(len(order), dtype=np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    flat, words = place[flat], list(numbers)
    words = [words[i] for i in order.tolist()]
    training = np.repeat(np.array([not held_out(i) for i in ids]), size)
    counts = np.bincount(flat[training], minlength=len(words)).astype(np.uint32)
    hashes = [xxh3_64_intdigest(w) for w in words]
    return {
        "pack": number,
        "ids": ids,
        "lengths": size.tobytes(),
        "tokens": zstandard.compress(flat.tobytes(), 3),
        "words": np.array(hashes, dtype=np.uint64).tobytes(),
        "leaves": np.array([shared_leaf(w, h) if w else FREQUENT for w, h in zip(words, hashes, strict=True)], dtype=np.uint16).tobytes(),
        "counts": zstandard.compress(counts.tobytes(), 3),
        "n_words": len(words),
        "n_train": int(training.sum()),
    }


def packs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 16, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and size + len(t or "") > PACK:
                    yield pa.RecordBatch.from_pylist([_pack(number, ids, texts)], schema=_PACKS)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t or "")
        if ids:
            yield pa.RecordBatch.from_pylist([_pack(number, ids, texts)], schema=_PACKS)

    plain = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = int(-(-(plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART)) or 1
    place = F.xxhash64("doc_id", "text")
    dealt = plain.withColumn("place", place).repartition(parts, "place").sortWithinPartitions("place", "doc_id").drop("place")
    return written(dealt.mapInArrow(run, _PACK_DDL))


def counted(packed: DataFrame) -> tuple[DataFrame, int]:
    """Answers ``pack, shard, totals`` and, with pack -1, a row of sums and frequent words per shard; and the shards."""
    entries = packed.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-entries // SHARD))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("pack", pa.int64()), ("words", pa.binary()), ("leaves", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = np.frombuffer(row["words"], np.uint64), np.frombuffer(zstandard.decompress(row["counts"]), np.uint32)
                leaves = np.frombuffer(row["leaves"], np.uint16)
                order, of, edge = by_shard(words, shards)
                words, leaves, counts = words[order], leaves[order], counts[order]
                out = [{"shard": s, "pack": row["pack"], "words": words[a:b].tobytes(), "leaves": leaves[a:b].tobytes(), "counts": counts[a:b].tobytes()} for s, a, b in zip(of, edge, edge[1:])]
                for a in range(0, len(out), 1_000):
                    yield pa.RecordBatch.from_pylist(out[a : a + 1_000], schema=schema)

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        words, leaves, counts = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("words", np.uint64), ("leaves", np.uint16), ("counts", np.uint32)))
        distinct, first, inverse = np.unique(words, return_index=True, return_inverse=True)
        totals = np.bincount(inverse, weights=counts).astype(np.int64)
        answer, ends = totals[inverse], np.cumsum([len(w) // 8 for w in pdf["words"]])
        known = totals > 0
        top = np.lexsort((distinct.view(np.int64), -totals))[:FREQUENT]
        top = top[totals[top] > 0]
        leaf = leaves[first].astype(np.int64)
        sums = np.stack([np.bincount(leaf[known], weights=totals[known], minlength=LEAVES), np.bincount(leaf[known], minlength=LEAVES)]).astype(np.int64)
        rows = {
            "pack": [*pdf["pack"], -1],
            "shard": [int(pdf["shard"].iloc[0])] * (len(pdf) + 1),
            "totals": [*(zstandard.compress(x.tobytes(), 3) for x in np.split(answer, ends[:-1])), None],
            "n": [0] * len(pdf) + [int(totals.sum())],
            "v": [0] * len(pdf) + [int(known.sum())],
            "by_leaf": [None] * len(pdf) + [sums.ravel().tolist()],
            "top": [None] * len(pdf) + [[{"word": int(w), "n": int(n), "leaf": int(s)} for w, n, s in zip(distinct[top].view(np.int64), totals[top], leaf[top], strict=True)]],
        }
        return pd.DataFrame(rows)

    dealt = packed.select("pack", "words", "leaves", "counts").mapInArrow(deal, "shard int, pack long, words binary, leaves binary, counts binary")
    return written(dealt.groupBy("shard").applyInPandas(add_up, "pack long, shard int, totals binary, n long, v long, by_leaf array<long>, top array<struct<word:long,n:long,leaf:int>>")), shards


def by_shard(words: np.ndarray, shards: int) -> tuple[np.ndarray, list[int], list[int]]:
    """An order of the words by shard; the shards that have any; and where the words of each begin, and all end."""
    to = (words % np.uint64(shards)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    to = to[order]
    edge = np.flatnonzero(np.diff(to, prepend=-1))
    return order, to[edge].tolist(), [*edge.tolist(), len(to)]


class Corpus:
    """Corpus sums and the frequent words; bounded, whatever the corpus."""

    def __init__(self, answers: DataFrame, shards: int):
        sums = answers.where("pack = -1")
        row = sums.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
        self.n, self.v, self.shards = row.n or 0, row.v or 0, shards
        of = np.zeros((2, LEAVES), dtype=np.int64)
        for r in sums.select(F.posexplode("by_leaf").alias("i", "x")).where("x > 0").groupBy("i").agg(F.sum("x").alias("x")).collect():
            of.ravel()[r.i] = r.x
        top = sums.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
        self.frequent = np.array([r.word for r in top], dtype=np.int64).view(np.uint64)
        for i, r in enumerate(top):
            of[:, r.leaf] -= (r.n, 1)
            of[:, i] = (r.n, 1)
        #: Training tokens and distinct words of each leaf.
        self.leaf_n, self.leaf_v = of
        self.order = np.argsort(self.frequent)

    def leaves(self, words: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """The leaf of each distinct word: its rank if frequent, else the shared one."""
        out = shared.astype(np.int32)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent[self.order], words), len(self.frequent) - 1)
            hit = self.frequent[self.order[at]] == words
            out[hit] = self.order[at[hit]]
        return out

    def within(self, leaves: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Natural log of P(word | leaf)."""
        share = np.log((totals + 1) / (self.leaf_n[leaves] + self.leaf_v[leaves] + 1))
        return np.where(leaves < FREQUENT, 0.0, share)


def contexts(leaves: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """What each token's features are taken from: the leaves 1 to CONTEXT back, and the last two hashed."""
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(leaves)) - starts
    out = []
    for k in range(1, CONTEXT + 1):
        before = np.full(len(leaves), LEAVES, dtype=np.int32)
        before[k:] = leaves[:-k]
        before[place < k] = LEAVES
        out.append(before)
    out.append(((out[0].astype(np.int64) * 1_000_003 + out[1] * 8_191) % 2_147_483_629).astype(np.int32))
    return out


def nodes(leaves: np.ndarray) -> list[np.ndarray]:
    """The node of the tree that each level decides at: 0, the class, both classes."""
    return [np.zeros(len(leaves), dtype=np.int32), leaves // WAYS**2, leaves // WAYS]


def table_rows(level: int, feature: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Rows of a table of this level, by feature and node."""
    x = feature.astype(np.uint32) * np.uint32(2_654_435_761) + node.astype(np.uint32) * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return (x >> np.uint32(32 - ROWS.bit_length() + 1)).astype(np.uint16)


class Model:
    """``bias[level][node]`` from the unigrams; one learned table of ``ROWS`` rows per level and feature."""

    def __init__(self, corpus: Corpus):
        counts = corpus.leaf_n.astype(float)
        self.bias = []
        for level in range(LEVELS):
            below = counts.reshape(WAYS ** (level + 1), -1).sum(1) + 0.5
            self.bias.append(np.log(below.reshape(-1, WAYS) / below.reshape(-1, WAYS).sum(1, keepdims=True)).astype(np.float32))
        self.tables = [np.zeros((ROWS, WAYS), np.float32) for own in FEATURES for _ in own]


def _levels(model: Model, leaves: np.ndarray, features: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Per level: its first table, the rows in each of its tables, the sums per outcome, and the outcomes."""
    first = 0
    for level, node in enumerate(nodes(leaves)):
        rows = [table_rows(level, features[f], node) for f in FEATURES[level]]
        z = np.take(model.bias[level], node, axis=0, mode="clip")
        part = np.empty_like(z)
        for i, r in enumerate(rows):
            z += np.take(model.tables[first + i], r, axis=0, mode="clip", out=part)
        yield first, rows, z, leaves // WAYS ** (LEVELS - 1 - level) % WAYS
        first += len(rows)


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``z`` less its maximum, exponentiated in place; the sums; and the maxima."""
    top = z.max(1)
    z -= top[:, None]
    np.exp(z, out=z)
    return z.sum(1), top


def _log_softmax_at(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    own = z[np.arange(len(y)), y]
    total, top = _exp(z)
    return own - top - np.log(total)


def log_probabilities(model: Model, leaves: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """Natural log of P(leaf | context) of each token."""
    out = np.zeros(len(leaves))
    for a in range(0, len(leaves), BATCH):
        at = slice(a, a + BATCH)
        for _, _, z, y in _levels(model, leaves[at], [f[at] for f in features]):
            out[at] += _log_softmax_at(z, y)
    return out


class Trainer:
    """AdaGrad steps (one rate a row) from given weights, which stay as they are."""

    def __init__(self, model: Model):
        self.model = copy.copy(model)
        self.model.tables = [t.copy() for t in model.tables]
        self.squares = [np.full(ROWS, 1e-2, np.float32) for _ in model.tables]
        #: Tokens that moved each row.
        self.moved = [np.zeros(ROWS, np.float32) for _ in model.tables]

    def _step(self, i: int, rows: np.ndarray, gradient: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")  # 16 bits: by radix
        sorted_rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
        total, row = np.add.reduceat(np.take(gradient, order, axis=0), first, axis=0), sorted_rows[first]
        self.moved[i][row] += np.diff(first, append=len(rows))
        square = self.squares[i][row] + np.einsum("ij,ij->i", total, total) / WAYS
        self.squares[i][row] = square
        total *= (-RATE / np.sqrt(square))[:, None]
        total += np.take(self.model.tables[i], row, axis=0)
        self.model.tables[i][row] = total

    def learn(self, leaves: np.ndarray, features: list[np.ndarray]) -> None:
        for a in range(0, len(leaves), STEP):
            at = slice(a, a + STEP)
            for first, rows, z, y in _levels(self.model, leaves[at], [f[at] for f in features]):
                z /= _exp(z)[0][:, None]
                z[np.arange(len(y)), y] -= 1
                for i, r in enumerate(rows):
                    self._step(first + i, r, z)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(zstandard.decompress(row["tokens"]), np.uint32), np.frombuffer(row["lengths"], np.uint32).astype(np.int64), np.frombuffer(row["words"], np.uint64), np.frombuffer(row["leaves"], np.uint16))


def train(packed: DataFrame, corpus: Corpus) -> Model:
    """One pass over all training packs, in rounds of local gradient steps that are averaged after each."""
    spark = packed.sparkSession
    model = Model(corpus)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, words = held.value
        change, weight = [np.zeros_like(t) for t in start.tables], [np.zeros(ROWS, np.float32) for _ in start.tables]
        for batch in batches:
            for row in batch.to_pylist():
                flat, lengths, hashes, shared = _opened(row)
                leaves = words.leaves(hashes, shared)[flat]
                keep = np.repeat(np.array([not held_out(i) for i in row["ids"]]), lengths)
                trainer = Trainer(start)
                trainer.learn(leaves[keep], [f[keep] for f in contexts(leaves, lengths)])
                for c, w, new, old, n in zip(change, weight, trainer.model.tables, start.tables, trainer.moved, strict=True):
                    c += (new - old) * n[:, None]
                    w += n
        if any(w.any() for w in weight):
            schema = pa.schema([("block", pa.int32()), ("start", pa.int32()), ("part", pa.int32()), ("change", pa.binary()), ("weight", pa.binary())])
            part = TaskContext.get().partitionId() // FAN_IN
            for i, (c, w) in enumerate(zip(change, weight, strict=True)):
                yield pa.RecordBatch.from_pylist([{"block": i, "start": a, "part": part, "change": c[a : a + SLICE].tobytes(), "weight": w[a : a + SLICE].tobytes()} for a in range(0, ROWS, SLICE)], schema=schema)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        change, weight = (np.sum([np.frombuffer(x, np.float32) for x in pdf[c]], axis=0, dtype=np.float32) for c in ("change", "weight"))
        first = pdf.iloc[0]
        return pd.DataFrame({"block": [int(first["block"])], "start": [int(first["start"])], "change": [change.tobytes()], "weight": [weight.tobytes()]})

    added = "block int, start int, change binary, weight binary"
    turn = F.pmod(F.shiftright("pack", 16) + F.col("pack").bitwiseAND(0xFFFF), F.lit(ROUNDS))
    sizes = {r.turn: r["count"] for r in packed.where("n_train > 0").groupBy(turn.alias("turn")).count().collect()}
    for k, n in sorted(sizes.items()):
        held = spark.sparkContext.broadcast((model, corpus))
        share = packed.where((turn == k) & (F.col("n_train") > 0)).select("pack", "ids", "lengths", "tokens", "words", "leaves")
        changes = share.coalesce(-(-n // TASK_PACKS)).mapInArrow(local, "block int, start int, part int, change binary, weight binary")
        near = changes.groupBy("block", "start", "part").applyInPandas(add, added)
        new = copy.copy(model)
        new.tables = [t.copy() for t in model.tables]
        for r in near.groupBy("block", "start").applyInPandas(add, added).collect():
            weight = np.frombuffer(r.weight, np.float32)
            new.tables[r.block][r.start : r.start + len(weight)] += np.frombuffer(r.change, np.float32).reshape(-1, WAYS) / np.maximum(weight, 1)[:, None]
        held.unpersist()
        model = new
    return model


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(packed: DataFrame, answers: DataFrame, corpus: Corpus, model: Model) -> DataFrame:
    spark = packed.sparkSession
    held = spark.sparkContext.broadcast((model, corpus))
    own = answers.where("pack >= 0").groupBy(F.col("pack").alias("p2")).agg(F.collect_list(F.struct("shard", "totals")).alias("answers"))
    joined = packed.join(own, F.col("pack") == F.col("p2")).select("ids", "lengths", "tokens", "words", "leaves", "answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, c = held.value
        for batch in batches:
            for row in batch.to_pylist():
                flat, lengths, hashes, shared = _opened(row)
                order, _, _ = by_shard(hashes, c.shards)
                totals = np.empty(len(hashes), dtype=np.int64)
                totals[order] = np.concatenate([np.frombuffer(zstandard.decompress(x["totals"]), np.int64) for x in sorted(row["answers"], key=lambda x: x["shard"])])
                leaves = c.leaves(hashes, shared)
                base = np.log10((totals + 1) / (c.n + (c.v + 1)))
                doc = np.repeat(np.arange(len(lengths)), lengths)
                by_token = log_probabilities(m, leaves[flat], contexts(leaves[flat], lengths)) + c.within(leaves, totals)[flat]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()),
                        pa.array([held_out(i) for i in row["ids"]]),
                        pa.array(lengths),
                        pa.array(np.bincount(doc, weights=(totals > 0)[flat], minlength=len(lengths)).astype(np.int64)),
                        pa.array(np.full(len(lengths), c.n, dtype=np.int64)),
                        pa.array(np.bincount(doc, weights=base[flat], minlength=len(lengths))),
                        pa.array(np.bincount(doc, weights=by_token, minlength=len(lengths)) / np.log(10)),
                    ],
                    schema=_SCORES,
                )

    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def report(documents: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    packed = packs(documents)
    answers, shards = counted(packed)
    corpus = Corpus(answers, shards)
    return score(packed, answers, corpus, train(packed, corpus))
