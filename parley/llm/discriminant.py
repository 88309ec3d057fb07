"""Quality classifier: a regularised quadratic discriminant over statistics of the text.

Each text becomes a few counts and shares (``statistics``), transformed so that one kind of
document is about a normal cloud: logarithms of counts and of shares, scaled by the spread over
all labelled rows. Either class has a mean and a covariance, added up by Spark over all labelled
rows of the training fold, centred first. A covariance is shrunk towards the pooled one where the
class is small, and towards a multiple of the identity by the oracle-approximating intensity, so
it has a Cholesky factor; factors are computed once and go to the tasks. A score is the logistic
function of the difference of the log densities (half the Mahalanobis distances and the log
determinants) plus the log prior, flattened by a two-parameter logistic fit to the training rows.

Only ``labels.quality`` and the text are learnt from. Defined cases: a null or empty text has all
statistics zero and is scored like any other; without labels of both classes every score is the
share of good labels (0 without any); repeated labels of an id count once (the lowest), labels
other than 0 and 1 not at all, null ids never match; repeated documents count each; very long
texts are read in one piece, at the memory of their own words; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, remainder, written

#: A share is added to this before its logarithm, so that none and little are near.
FLOOR = 0.01
#: Strength of the pooled covariance: it counts as so many rows a statistic.
POOL = 2.0
BINS = 4_096
#: Bound of the log odds of the two densities: what lies beyond counts the same.
CLIP = 60.0
#: Newton steps of the two-parameter calibration, and the penalty that keeps it finite.
NEWTON, RIDGE = 12, 1.0
#: A document is predicted good from this score on.
CUTOFF = 0.3

NAMES = (
    "words", "word_length", "word_spread", "distinct_share", "top_share", "pair_share", "symbol_share", "punctuation_share", "upper_share", "digit_share",
    "space_share", "bare_share", "odd_end_share", "line_words", "repeated_lines", "run_share",
)
_SPACE = bytes(range(9, 14)) + b" "
#: Classes of bytes: 1 upper case, 2 digit, 3 plain punctuation, 4 other signs, 5 white space, 0 anything else.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[48:58], _CLASS[list(b".,;:?'\"()-")], _CLASS[list(_SPACE)] = 1, 2, 3, 5
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and b not in b".,;:?'\"()-"]] = 4
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_PLAIN_END = re.compile(rb"[A-Za-z0-9\x80-\xff][.,;:?'\")]*$")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of ``NAMES``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(1, len(data))
    kinds = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=6)
    some = max(1, n)
    counts = Counter(words)
    bare = ends = 0
    for w, c in counts.items():
        if not _LETTER.search(w):
            bare += c
        if not _PLAIN_END.search(w):
            ends += c
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n) if n else np.zeros(1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper = kinds[1] / max(1, size - kinds[2] - kinds[3] - kinds[4] - kinds[5])
    log, share = np.log, lambda a, b: float(np.log(FLOOR + a / max(1, b)))
    return [
        float(log(n + 1)), float(log(lengths.mean() + 1)), float(log(lengths.std() + 1)), share(len(counts), some), share(max(counts.values(), default=0), some), share(n - 1 - pairs if n > 1 else 0, some),
        share(kinds[4], size), share(kinds[3], size), float(log(FLOOR + upper)), share(kinds[2], size),
        share(kinds[5], size), share(bare, some), share(ends, some), float(log(n / max(1, len(lines)) + 1)), share(len(lines) - len(set(lines)), len(lines)), share(repeats, some),
    ]


def class_sums(rows: DataFrame, center: dict[int, np.ndarray] | None = None) -> dict[int, tuple[int, np.ndarray]]:
    """Count and sum of ``z`` per class, or with ``center`` count and sum of the centred products.

    Tasks add up; one row per class and place of the sum is shuffled, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0).to_numpy(zero_copy_only=False)
                z = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for c in np.unique(y):
                    own = z[y == c]
                    part = own.sum(axis=0) if center is None else ((own - center[int(c)]).T @ (own - center[int(c)])).ravel()
                    part = np.concatenate([[len(own)], part])
                    total[int(c)] = total[int(c)] + part if int(c) in total else part
        for c, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, dtype=np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["y", "at", "v"])

    found: dict[int, list] = {}
    for r in rows.select("y", "z").mapInArrow(run, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r.y, []).append((r.at, r.v))
    out = {c: np.array([v for _, v in sorted(parts)]) for c, parts in found.items()}
    return {c: (int(round(v[0])), v[1:]) for c, v in out.items()}


def shrunk(cov: np.ndarray, n: int) -> np.ndarray:
    """Towards a multiple of the identity, by the oracle-approximating intensity of ``n`` rows."""
    p = len(cov)
    square, trace = float((cov * cov).sum()), float(np.trace(cov))
    below = (n + 1 - 2 / p) * (square - trace * trace / p)
    rho = 1.0 if below <= 0 else min(1.0, ((1 - 2 / p) * square + trace * trace) / below)
    return (1 - rho) * cov + (rho * trace / p + 1e-6) * np.eye(p)


class Model:
    """Means, Cholesky factors and priors of the classes 0 and 1; ``scale`` is applied first."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, means: list[np.ndarray], covariances: list[np.ndarray], prior: float, line=(1.0, 0.0)):
        self.mean, self.scale, self.means, self.prior, self.line = mean, scale, means, prior, line
        self.lower = [np.linalg.inv(np.linalg.cholesky(c)) for c in covariances]
        self.half_log_det = [-float(np.log(np.diag(i)).sum()) for i in self.lower]

    def log_odds(self, z: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, plus the log prior odds."""
        x = (z - self.mean) / self.scale
        density = [-0.5 * (((x - m) @ i.T) ** 2).sum(axis=1) - h for m, i, h in zip(self.means, self.lower, self.half_log_det, strict=True)]
        return np.clip(density[1] - density[0] + np.log(self.prior / (1 - self.prior)), -CLIP, CLIP)

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.line[0] * self.log_odds(z) + self.line[1])))


class Constant:
    """What stands in for a model where one class has no label."""

    def __init__(self, share: float):
        self.share = share

    def score(self, z: np.ndarray) -> np.ndarray:
        return np.full(len(z), self.share)


def calibrated(odds: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic fit to counts of good and bad rows at log odds; starts from and is drawn to (1, 0)."""
    line = np.array([1.0, 0.0])
    x = np.stack([odds, np.ones_like(odds)])
    for _ in range(NEWTON):
        p = 1 / (1 + np.exp(-(line @ x)))
        slope = x @ (good - (good + bad) * p) - RIDGE * (line - np.array([1.0, 0.0]))
        step = np.linalg.solve((x * ((good + bad) * p * (1 - p))) @ x.T + RIDGE * np.eye(2), slope)
        line = line + np.clip(step, -1, 1)
    return float(max(line[0], 1e-3)), float(line[1])


def training_rows(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """``y, z`` of the labelled documents outside the held-out fold."""
    marks = labels.where(F.col("quality").isin(0, 1) & (remainder("doc_id", 5) != 0)).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").cast("int").alias("y"))
    return measured.where(remainder("doc_id", 5) != 0).join(marks, F.col("doc_id") == F.col("label_id")).select("y", "z")


def fit(rows: DataFrame) -> Model | Constant:
    """``rows``: ``y`` (0 or 1) and ``z`` (array of statistics). Three passes of sums, none collected."""
    sums = class_sums(rows)
    n = {c: v[0] for c, v in sums.items()}
    if len(n) < 2:
        return Constant(float(next(iter(n), 0)))
    total = n[0] + n[1]
    means = {c: v / n[c] for c, (_, v) in sums.items()}
    mean = (n[0] * means[0] + n[1] * means[1]) / total
    scatter = {c: v.reshape(len(mean), -1) for c, (_, v) in class_sums(rows, means).items()}
    between = sum(n[c] * np.outer(means[c] - mean, means[c] - mean) for c in n)
    scale = np.sqrt(np.maximum(np.diag(scatter[0] + scatter[1] + between) / total, 1e-12))
    both = np.outer(scale, scale)
    pooled = (scatter[0] + scatter[1]) / total / both
    weight = {c: n[c] / (n[c] + POOL * len(mean)) for c in n}
    covariances = [shrunk(weight[c] * (scatter[c] / n[c] / both) + (1 - weight[c]) * pooled, n[c]) for c in (0, 1)]
    model = Model(mean, scale, [(means[c] - mean) / scale for c in (0, 1)], covariances, n[1] / total)
    # log odds of the training rows, counted in bins of a fixed number
    held = rows.sparkSession.sparkContext.broadcast(model)

    def binned(y: list, z: list) -> dict:
        at = ((held.value.log_odds(np.array(z)) + CLIP) / (2 * CLIP) * (BINS - 1)).round().astype(np.int64)
        both = np.bincount(at * 2 + np.array(y), minlength=2 * BINS).reshape(-1, 2)
        used = np.flatnonzero(both.sum(axis=1))
        return {"at": used, "bad": both[used, 0], "good": both[used, 1]}

    bins = per_batch(rows, "at long, bad long, good long", binned, "y", "z").groupBy("at").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).orderBy("at").toPandas()
    model.line = calibrated(bins["at"].to_numpy() / (BINS - 1) * 2 * CLIP - CLIP, bins["good"].to_numpy(dtype=float), bins["bad"].to_numpy(dtype=float))
    return model


def measured(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, z`` of every document: one pass over the texts."""
    plain = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return per_batch(plain, "doc_id long, z array<double>", lambda ids, texts: {"doc_id": ids, "z": [statistics(t) for t in texts]}, "doc_id", "text")


def score(rows: DataFrame, model: Model | Constant) -> DataFrame:
    """``doc_id, score`` of measured documents."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    return per_batch(rows, "doc_id long, score double", lambda ids, z: {"doc_id": ids, "score": held.value.score(np.array(z))}, "doc_id", "z")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    rows = written(measured(documents))
    model = fit(written(training_rows(rows, labels)))
    return score(rows, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
