"""Queries of models. Fitted ones have no SQL form and are tested by their properties; predictions of given weights have."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from parley.operators import models, reports
from parley.operators.graphs import written

from .fixtures import DUCKDB, TAUS, ctes, fixture
from .q_io import folder
from .q_metrics import MACRO, per_class_sql, r, rounded
from .q_signals import _long
from .registry import query


def _samples(spark, d):
    k = F.col("window_id") % 10
    return fixture(spark, d, "e_pairs").select(F.col("window_id").cast("string").alias("sample_key"), "window_id", F.when(k < 6, "train").when(k < 7, "val").otherwise("test").alias("split"), F.col("label").cast("int").alias("label"))


def _labels(spark, d):
    taus = F.explode(F.array(*[F.lit(t) for t in TAUS]))
    rows = _samples(spark, d).select("sample_key", "window_id", "label", taus.alias("tau_ms"))
    moved = (F.col("tau_ms") != 400) & ((F.col("window_id") + F.col("tau_ms") / 100) % 5 == 0)
    return rows.select("sample_key", "tau_ms", F.when(moved, (F.col("label") + 1) % 3).otherwise(F.col("label")).alias("label"))


def _features(spark, d, streams):
    return _samples(spark, d).join(models.pool_features(_long(spark, d), streams), "window_id")


def _split(f, split):
    return f.where(F.col("split") == split).select("features", "label")


@query("train_classifier")
def train_classifier(spark, d):
    f = written(_features(spark, d, ("speaker", "listener")))
    model = models.train_classifier(_split(f, "train"), _split(f, "val"))
    return models.predict_records(model, f.where("split = 'test'")).select("sample_key", "label", "pred", "correct", "probs")


@query("training_history")
def training_history(spark, d):
    """Per epoch validation macro F1 and loss, and the epochs that were best and last, as found from the history."""
    f = written(_features(spark, d, ("speaker", "listener")))
    history = models.train_classifier(_split(f, "train"), _split(f, "val")).history_frame(spark).withColumn("run", F.lit(1))
    best, stop = reports.best_epoch(history, "macro_f1", ["run"]), reports.early_stop_epoch(history, "macro_f1", ["run"])
    return history.join(best, "run").join(stop, "run").select("epoch", "macro_f1", "loss", "best_epoch", "stop_epoch")


# Given weights of three classes over the two pooled features of the speaker, and intercepts: predictions that SQL can repeat.
WEIGHTS = [[6.0, -4.0, 0.1], [-5.0, 3.0, 0.0], [1.0, 4.0, -0.2]]
_SCORED = ctes(["e_pairs", "e_frames"], DUCKDB) + """, m AS (SELECT window_id, avg(x) FILTER (feature = 0) AS f0, avg(x) FILTER (feature = 1) AS f1 FROM e_frames GROUP BY window_id),
z AS (SELECT window_id, """ + ", ".join(f"{b}e0 + f0 * {u}e0 + f1 * {v}e0 AS z{c}" for c, (u, v, b) in enumerate(WEIGHTS)) + """ FROM m),
e AS (SELECT window_id, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1, exp(z2 - greatest(z0, z1, z2)) AS e2 FROM z),
p AS (SELECT CAST(window_id AS VARCHAR) AS sample_key, window_id, CAST(label AS INT) AS label, window_id % 10 AS k, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END AS pred FROM e JOIN e_pairs USING (window_id))"""


@query("predict_records", _SCORED + " SELECT sample_key, CASE WHEN k < 6 THEN 'train' WHEN k < 7 THEN 'val' ELSE 'test' END AS split, label, pred, pred = label AS correct, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p2, 9) AS p2 FROM p")
def predict_records(spark, d):
    scored = models.predict_records(models.Classifier(np.array(WEIGHTS)), _features(spark, d, ("speaker",)))
    return scored.select("sample_key", "split", "label", "pred", "correct", *[F.round(F.col("probs")[c], 9).alias(f"p{c}") for c in range(3)])


_SWEEP = _SCORED + f""", taus AS (SELECT unnest([{', '.join(map(str, TAUS))}]) AS tau_ms),
swept AS (SELECT tau_ms, pred, CASE WHEN tau_ms <> 400 AND (window_id + tau_ms // 100) % 5 = 0 THEN (label + 1) % 3 ELSE label END AS label FROM p, taus WHERE k >= 7), """ + per_class_sql("swept", ["tau_ms"])


@query("tau_sweep", _SWEEP + f" SELECT tau_ms, n, {r(*MACRO)} FROM mac")
def tau_sweep(spark, d):
    model = models.Classifier(np.array(WEIGHTS))
    return rounded(models.tau_sweep(models.predict_records(model, _features(spark, d, ("speaker",)).where("split = 'test'")), _labels(spark, d)))


@query("ablation_block")
def ablation_block(spark, d):
    experiments = {"speaker_only": ("speaker",), "both": ("speaker", "listener")}
    path = folder(spark)
    return models.ablation_block(experiments, _long(spark, d), written(_samples(spark, d).drop("label")), written(_labels(spark, d)), path=path, block="roles", evaluate=("test", "val"))
