"""Pooled features, a class-weighted softmax classifier trained in epochs, predictions, and the tau sweep."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.sources.sinks import commit_results, commits, read_committed

from .graphs import written
from .metrics import class_weights, macro_metrics, per_class_metrics, run_experiments, run_index


def pool_features(frames: DataFrame, streams: tuple[str, ...], mode: str = "mean", by: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """``by, features``: mean (or last frame) of each feature of each stream, streams in given order.

    ``frames``: by, stream, frame, feature, value.
    """
    value = F.avg("value") if mode == "mean" else F.max(F.struct("frame", "value"))["value"]
    pooled = frames.where(F.col("stream").isin(*streams)).groupBy(*by, "stream", "feature").agg(value.alias("v"))
    order = F.array_position(F.array(*[F.lit(s) for s in streams]), F.col("stream"))
    packed = pooled.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "feature", "v"))).alias("p"))
    return packed.select(*by, F.transform("p", lambda x: x["v"]).alias("features"))


@dataclass
class Classifier:
    """Weights of the classes over features (the last one of each row is its intercept).

    ``history``: per epoch the macro F1 on the validation rows and the training loss; ``best_epoch``
    is the epoch whose weights these are, ``stop_epoch`` the last that was run.
    """

    weights: np.ndarray
    history: list[tuple[int, float, float]] = field(default_factory=list)
    best_epoch: int = 0
    stop_epoch: int = 0

    def history_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.history, "epoch int, macro_f1 double, loss double")

    def probabilities(self, features: Column) -> Column:
        """Softmax over the classes, as an array; built-in functions only."""
        rows = F.array(*[F.array(*[F.lit(float(v)) for v in row[:-1]]) for row in self.weights])
        intercepts = F.array(*[F.lit(float(row[-1])) for row in self.weights])
        dot = lambda w, b: b + F.aggregate(F.zip_with(features, w, lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v)
        scores = F.zip_with(rows, intercepts, dot)
        let = lambda value, use: F.get(F.transform(F.array(value), use), 0)
        shifted = let(scores, lambda z: let(F.array_max(z), lambda m: F.transform(z, lambda v: F.exp(v - m))))
        return let(shifted, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda t: F.transform(e, lambda v: v / t)))


def _sums(rows: DataFrame, of, size: int) -> np.ndarray:
    """Sums over all rows of the vector that ``of`` makes of a batch; tasks add up, then one row a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total += of(x, *[batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 4)])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "v"])

    out = np.zeros(size)
    for r in rows.select("features", "label", "weight", "held").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r.v
    return out


def _macro_f1(cells: np.ndarray) -> float:
    """Macro F1 of a confusion matrix (true classes in rows); 0/0 is 0."""
    tp = np.diag(cells)
    return float(np.mean(2 * tp / np.maximum(cells.sum(axis=0) + cells.sum(axis=1), 1)))


def train_classifier(train: DataFrame, val: DataFrame | None = None, k: int = 3, weights: DataFrame | None = None, seed: int = 0, epochs: int = 40, patience: int = 4, rate: float = 0.3, reg: float = 0.01) -> Classifier:
    """``features array<double>, label`` to softmax weights, balanced by class.

    Each epoch is one pass that sums the gradient over the training rows and the confusion matrix
    over the validation rows, both under the weights at hand; an adaptive step follows. Training
    ends after ``patience`` epochs without a strictly better macro F1, and the weights of the best
    epoch are kept (the last ones without ``val``). ``weights``: ``label, weight``, else those
    of ``class_weights``. The seed fixes the first weights. Labels outside 0..k-1 are left out.
    """
    inside = F.col("label").between(0, k - 1)
    marked = train.where(inside).select("features", F.col("label").cast("int").alias("label"), F.lit(0).alias("held"))
    weights = class_weights(train.where(inside), k) if weights is None else weights
    if val is not None:
        marked = marked.unionByName(val.where(inside).select("features", F.col("label").cast("int").alias("label"), F.lit(1).alias("held")))
    joined = marked.join(weights.select(F.col("label").alias("_l"), "weight"), F.col("label") == F.col("_l"), "left")
    rows = written(joined.select("features", "label", F.coalesce("weight", F.lit(0.0)).alias("weight"), "held"))
    first = rows.select(F.size("features").alias("d")).limit(1).collect()
    if not first:
        raise ValueError("no rows to train on")
    d = first[0].d
    moments = _sums(rows, lambda x, y, w, h: np.concatenate([[np.sum(h == 0)], x[h == 0].sum(axis=0)]), d + 1)
    mean = moments[1:] / max(1, moments[0])
    square = _sums(rows, lambda x, y, w, h: ((x[h == 0] - mean) ** 2).sum(axis=0), d)
    scale = np.sqrt(np.maximum(square / max(1, moments[0]), 1e-12))
    theta = np.random.default_rng(seed).normal(scale=0.01, size=(k, d + 1))
    size = k * (d + 1)

    def measured(x, y, w, h, theta):
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        s = z @ theta.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        own = h == 0
        g = p[own].copy()
        g[np.arange(len(g)), y[own]] -= 1
        loss = -(w[own] * np.log(np.maximum(p[own, y[own]], 1e-15))).sum()
        cells = np.bincount(y[~own] * k + p[~own].argmax(axis=1), minlength=k * k)
        return np.concatenate([((g * w[own][:, None]).T @ z[own]).ravel(), cells, [loss, w[own].sum()]])

    def unscaled(theta: np.ndarray) -> np.ndarray:
        plain = theta[:, :-1] / scale
        return np.column_stack([plain, theta[:, -1] - plain @ mean])

    history, best, kept = [], -1.0, theta
    first_moment, second_moment, best_epoch, epoch = np.zeros_like(theta), np.zeros_like(theta), 0, 0
    for epoch in range(1, epochs + 2):
        total = _sums(rows, lambda x, y, w, h, t=theta: measured(x, y, w, h, t), size + k * k + 2)
        loss = float(total[-2] / max(total[-1], 1e-12))
        if epoch > 1:  # the weights of epoch - 1 are now measured
            f1 = _macro_f1(total[size : size + k * k].reshape(k, k)) if val is not None else float("nan")
            history.append((epoch - 1, f1, loss))
            if val is None or f1 > best:
                best, kept, best_epoch = f1, theta, epoch - 1
            if epoch > epochs or (val is not None and epoch - 1 - best_epoch >= patience):
                break
        g = total[:size].reshape(theta.shape) / max(total[-1], 1e-12)
        g[:, :-1] += reg * theta[:, :-1]
        first_moment, second_moment = 0.9 * first_moment + 0.1 * g, 0.99 * second_moment + 0.01 * g * g
        theta = theta - rate * (first_moment / (1 - 0.9**epoch)) / (np.sqrt(second_moment / (1 - 0.99**epoch)) + 1e-8)
    return Classifier(unscaled(kept), history, best_epoch, epoch - 1)


def predict_records(model: Classifier, samples: DataFrame) -> DataFrame:
    """Samples with ``probs``, the most probable class (lowest on ties), and whether it is right."""
    scored = samples.select(*[c for c in samples.columns if c != "features"], model.probabilities(F.col("features")).alias("probs"))
    pred = (F.array_position("probs", F.array_max("probs")) - 1).cast("int")
    return scored.withColumn("pred", pred).withColumn("correct", F.col("pred") == F.col("label"))


def tau_sweep(predictions: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """Macro metrics per tau: predictions are made once, and meet the labels of every tau.

    ``predictions``: sample_key, pred; ``labels``: sample_key, tau_ms, label. A tau without
    labels of the k classes has no row.
    """
    rows = predictions.select("sample_key", "pred").join(labels.where(F.col("label").between(0, k - 1)).select("sample_key", "tau_ms", "label"), "sample_key")
    return macro_metrics(per_class_metrics(rows, k, ["tau_ms"]), ["tau_ms"])


def ablation_block(experiments: dict[str, tuple[str, ...]], frames: DataFrame, samples: DataFrame, labels: DataFrame, train_tau: int = 400, path: str | None = None, block: str = "block", fusion: str = "early", evaluate: tuple[str, ...] = ("test",), seed: int = 0) -> DataFrame:
    """Experiments (name to streams) times taus: one model each, trained at ``train_tau`` on the
    train split, stopped and chosen on the val split, measured on the splits of ``evaluate``.

    ``samples``: sample_key, window_id, split; ``labels``: sample_key, tau_ms, label. With ``path``
    the results of each tau are committed as soon as they are there: a failure leaves the taus before
    it, and a rerun goes on after the last one and trains nothing that is complete. The index of the
    run stands beside them (``index``: the block, ``experiments``: configuration, epochs, score, as far
    as this run trained them).
    """
    spark, out, runs = samples.sparkSession, None, []
    taus = [r.tau_ms for r in labels.where(F.col("label").between(0, 2)).select("tau_ms").distinct().orderBy("tau_ms").collect()]
    done = set(commits(spark, path)) if path else set()
    for name, streams in experiments.items():
        if taus and all((name, t) in done for t in taus):
            continue
        features = written(samples.join(pool_features(frames, streams), "window_id"))
        at = labels.where((F.col("tau_ms") == train_tau) & F.col("label").between(0, 2)).select("sample_key", "label")
        labelled = features.join(at, "sample_key").select("features", "label", "split")
        val = labelled.where("split = 'val'")
        model = train_classifier(labelled.where("split = 'train'"), val if val.limit(1).count() else None, seed=seed)
        scored = written(predict_records(model, features.where(F.col("split").isin(*evaluate)).withColumn("label", F.lit(None).cast("int"))).select("sample_key", "split", "pred"))
        for tau in taus:
            if (name, tau) in done:
                continue
            met = scored.join(labels.where((F.col("tau_ms") == tau) & F.col("label").between(0, 2)).select("sample_key", "label"), "sample_key")
            rows = macro_metrics(per_class_metrics(met, 3, ["split"]), ["split"]).select(F.lit(name).alias("experiment"), F.lit(tau).alias("tau_ms"), "*")
            if path:
                commit_results(rows, path, name, tau)
            else:
                out = rows if out is None else out.unionByName(rows)
        runs.append((block, name, fusion, ",".join(streams), model.weights.size, model.best_epoch, model.stop_epoch))
    if path:
        out = read_committed(spark, path)
        results = out.where(F.col("split") == evaluate[0]).withColumn("block", F.lit(block))
        run_index(results, train_tau).write.mode("overwrite").json(f"{path}/index")
        if runs:
            table = spark.createDataFrame(runs, "block string, experiment string, fusion string, streams string, n_params long, best_epoch int, epochs_run int")
            run_experiments(results.where(F.col("experiment").isin(*[r[1] for r in runs])), table, train_tau).write.mode("append").json(f"{path}/experiments")
    return out
