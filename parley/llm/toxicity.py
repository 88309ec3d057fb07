"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features: hashed character n-grams (3 to 6 code points of the lower-cased text, runs of
non-letters as one blank), present or not. Each is scaled by its log-count ratio between toxic
and clean labelled documents; the n-grams whose ratio is most significant are kept, and a
logistic regression is fitted on them by gradient steps that Spark distributes (MLlib).

Only labelled rows of the training fold are learnt from, at most ``MAX_SAMPLE`` of them, chosen
by a hash of the id. Defined cases: a null or empty text has no n-gram and gets the score of the
intercept; without labels of both classes every score is the share of toxic labels (0 if none);
repeated documents are scored each; very long texts are read in runs of n-grams; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from parley.operators.graphs import scratch

from .common import code_points, letter_table, per_batch, remainder, written

SIZES = (3, 4, 5, 6)
BUCKETS_LOG2 = 20
#: n-grams that the classifier uses.
KEEP = 4_096
#: Most labelled rows that are learnt from.
MAX_SAMPLE = 20_000
#: Additive smoothing of the log-count ratios, strength of the L2 penalty.
SMOOTHING, PENALTY = 1.0, 0.002
RUN = 1_000_000
#: Tasks that look for the kept n-grams among the 2 ** BUCKETS_LOG2.
RANK_TASKS = 8


def buckets(text: str | None) -> np.ndarray:
    """Hash buckets of all n-grams of a text, with repeats."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    points = code_points(text.lower())
    letter = letter_table()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    x = np.concatenate([[32], np.where(letter, points, np.uint32(32))[keep], [32]]).astype(np.uint64)
    out = []
    for n in SIZES:
        if len(x) >= n:
            code = np.full(len(x) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                code *= np.uint64(0x100000001B3)
                code ^= x[k : len(x) - n + 1 + k]
            code *= np.uint64(0x9E3779B97F4A7C15)
            out.append((code >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


class Model:
    """``slot`` maps a bucket to a feature (or -1); ``weight`` is per feature, ratio included."""

    def __init__(self, features: np.ndarray, weight: np.ndarray, intercept: float):
        self.features, self.weight, self.intercept = features, weight, intercept

    def ready(self) -> Model:
        if not hasattr(self, "slot"):
            self.slot = np.full(1 << BUCKETS_LOG2, -1, dtype=np.int32)
            self.slot[self.features] = np.arange(len(self.features))
            self.seen = np.zeros(len(self.features) + 1, dtype=bool)
        return self

    def present(self, text: str | None) -> np.ndarray:
        """The features that a text has, ascending."""
        self.ready().seen[:] = False
        b = buckets(text)
        for a in range(0, len(b), RUN):
            self.seen[self.slot[b[a : a + RUN]]] = True  # -1 marks the spare last place
        return np.flatnonzero(self.seen[:-1])

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weight[self.present(text)].sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def log_count_ratios(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The kept buckets and their log-count ratios, from document frequencies per class."""

    def count(toxic: list, texts: list) -> dict:
        n = np.zeros((2, 1 << BUCKETS_LOG2), dtype=np.int64)
        for y, t in zip(toxic, texts, strict=True):
            n[y][np.unique(buckets(t))] += 1
        at = np.flatnonzero(n.sum(0))
        return {"bucket": at, "clean": n[0][at], "toxic": n[1][at]}

    df = per_batch(sample, "bucket long, clean long, toxic long", count, "toxic", "text").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = sample.groupBy("toxic").count().collect()
    n1, n0 = (next((r["count"] for r in total if r.toxic == y), 0) for y in (1, 0))
    p, q = (F.col("toxic") + SMOOTHING) / (n1 + 2 * SMOOTHING), (F.col("clean") + SMOOTHING) / (n0 + 2 * SMOOTHING)
    # significance: the ratio over its standard error
    spread = F.sqrt(1 / (F.col("toxic") + SMOOTHING) + 1 / (F.col("clean") + SMOOTHING))
    # a row a bucket at most, so few tasks hold them, and what meets in the last one is KEEP rows of each
    rated = df.withColumn("r", F.log(p / q)).coalesce(RANK_TASKS)
    top = rated.orderBy(F.desc(F.abs(F.col("r")) / spread), "bucket").limit(KEEP).orderBy("bucket").toPandas()
    return top.bucket.to_numpy(dtype=np.int64), top.r.to_numpy(dtype=float)


def training_sample(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of at most about ``MAX_SAMPLE`` labelled documents outside the held-out fold.

    The labels are sampled before the join, so the side that is broadcast is bounded and the
    documents are not shuffled. Of repeated labels the largest counts; repeated ids in
    ``documents`` count as often as they occur.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & (remainder("doc_id", 5) != 0)).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("label_toxic"))
    n = marks.count()
    chance = F.pmod(F.xxhash64(F.col("label_id").cast("string"), F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    few = marks.where(chance < min(1.0, MAX_SAMPLE / max(1, n)))
    texts = documents.select(F.col("doc_id").alias("d"), F.col("text").alias("text"))
    return texts.join(F.broadcast(few), F.col("d") == F.col("label_id")).select("text", F.col("label_toxic").alias("toxic"))


def fit(sample: DataFrame) -> Model:
    """``sample``: columns ``text, toxic`` (0 or 1), of bounded size."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import VectorUDT

    sample = written(sample)
    share = sample.agg(F.avg("toxic")).first()[0] or 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), 700.0 if share else -700.0)
    features, ratio = log_count_ratios(sample)
    shape = sample.sparkSession.sparkContext.broadcast(Model(features, ratio, 0.0))

    def sparse(toxic: list, texts: list) -> dict:
        """Labels and sparse vectors, in the struct that MLlib keeps them in (type 0)."""
        m, vectors = shape.value, []
        for t in texts:
            at = m.present(t)
            vectors.append({"type": 0, "size": len(m.weight), "indices": at, "values": m.weight[at]})
        return {"label": [float(y) for y in toxic], "features": vectors}

    schema = StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])
    data = written(per_batch(sample, schema, sparse, "toxic", "text"))
    # toxic rows are few: weights give both classes half of the loss, so that 0.5 lies between them
    weight = F.when(F.col("label") == 1.0, 0.5 / share).otherwise(0.5 / (1 - share))
    data = data.withColumn("weight", weight)
    model = LogisticRegression(weightCol="weight", regParam=PENALTY, elasticNetParam=0.0, standardization=False, maxIter=60, tol=1e-7).fit(data)
    return Model(features, model.coefficients.toArray() * ratio, float(model.intercept))


def score(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every whole text."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    plain = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return per_batch(plain, "doc_id long, score double", lambda ids, texts: {"doc_id": ids, "score": [held.value.score(t) for t in texts]}, "doc_id", "text")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    with scratch(documents.sparkSession):
        model = fit(training_sample(documents, labels))
    s = score(documents, model)
    return s.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
