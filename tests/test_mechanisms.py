"""Medians, time index, running sums, runs across partitions, first rows, label files, training,
commits, sidecars: each against a plain computation, on groups larger than its buffers."""

import json
import math
import os
import random
import shutil
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import filters, graphs, labelling, medians, metrics, models, reports, signals, timeindex, topn
from parley.sources import readers, sinks

# --- medians ------------------------------------------------------------------------------------


def values(kind, n, r):
    return {
        "normal": [r.gauss(0, 1) for _ in range(n)],
        "ties": [float(r.choice([0, 0, 0, 1, 2])) for _ in range(n)],
        "halves": [0.0] * (n // 2) + [1.0] * (n - n // 2),
        "one": [3.5] * n,
        "wide": [r.choice([-1, 1]) * 10.0 ** r.randrange(-300, 300) for _ in range(n)],
    }[kind]


@pytest.mark.parametrize("small", [10_000, 20, 1])
def test_medians_of_groups_of_any_size(spark, monkeypatch, small):
    monkeypatch.setattr(medians, "SMALL", small)
    monkeypatch.setattr(medians, "CUTS", 8)
    r = random.Random(small)
    rows, want = [], {}
    for kind in ("normal", "ties", "halves", "one", "wide"):
        for n in (1, 2, 39, 400, 401):
            v, w = values(kind, n, r), [r.random() if r.random() < 0.7 else None for _ in range(n)]
            rows += [(kind, n, a, b) for a, b in zip(v, w, strict=True)]
            some = [x for x in w if x is not None]
            want[kind, n] = (statistics.median(v), statistics.median(some) if some else None)
    rows += [(None, 7, 1.0, None), (None, 7, 2.0, None)]
    want[None, 7] = (1.5, None)
    df = spark.createDataFrame(rows, "g string, n int, v double, w double").repartition(5).cache()
    got = {(x.g, x.n): (x.mv, x.mw) for x in medians.medians(df, ["g", "n"], {"mv": "v", "mw": "w"}).collect()}
    assert got.keys() == want.keys()
    for k, (v, w) in want.items():
        assert got[k][0] == pytest.approx(v, rel=1e-15, abs=0) and (got[k][1] is None) == (w is None) and (w is None or got[k][1] == pytest.approx(w, rel=1e-15))
    all_rows = medians.medians(df, [], {"m": "v"}).collect()
    assert [x.m for x in all_rows] == [pytest.approx(statistics.median([x[2] for x in rows]), rel=1e-15)]


def test_a_large_group_is_narrowed_and_never_collected(spark, monkeypatch):
    """300,000 values, buffers of 500: the buffers are filled by what is left of each round."""
    monkeypatch.setattr(medians, "SMALL", 500)
    df = spark.range(300_001).select(F.lit("g").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("v"))
    got = medians.medians(df, ["g"], {"m": "v"}).collect()[0].m
    assert got == df.agg(F.median("v")).collect()[0][0]
    rounds, narrowed = [], medians._narrowed

    def counted(rows, keys):
        rounds.append(rows.count())
        return narrowed(rows, keys)

    monkeypatch.setattr(medians, "_narrowed", counted)
    medians.medians(df, ["g"], {"m": "v"}).collect()
    assert rounds[0] == 300_001 and all(b < a / 20 for a, b in zip(rounds, rounds[1:])) and len(rounds) <= 3


def test_label_medians_in_rounds_equal_plain_ones(spark, monkeypatch):
    r = random.Random(4)
    columns = sorted({c for _, c, _ in metrics._LABEL_SUMMARY})
    rows = [(f"f{i % 3}", i % 2, *[r.random() for _ in columns]) for i in range(200)]
    df = spark.createDataFrame(rows, "file_id string, label int, " + ", ".join(f"{c} double" for c in columns))
    plain = {x.label: x for x in metrics.coordination_label_summary(df).collect()}
    monkeypatch.setattr(medians, "SMALL", 10)
    for x in metrics.coordination_label_summary(df).collect():
        assert x.median_peak_corr == plain[x.label].median_peak_corr == pytest.approx(statistics.median([v[2 + columns.index("mean_max_abs_corr")] for v in rows if v[1] == x.label]))
        assert x.asDict().keys() == plain[x.label].asDict().keys()


# --- time index ---------------------------------------------------------------------------------


def conversation(r, files=4, seconds=120):
    """Random intervals (some long, some touching, some repeated) and words of two-party recordings."""
    intervals, words = [], []
    for f in range(files):
        t = 0.0
        for s in range(60):
            t += r.choice([0.0, 0.05, 0.3, 1.0])
            end = t + r.choice([0.0, 0.2, 0.4, 0.6, 0.9, 3.0, 20.0 if s % 25 == 0 else 0.5])
            intervals.append((f"f{f}", s, round(t, 3), round(end, 3)))
            for _ in range(r.randrange(4)):
                words.append((f"f{f}", r.choice(["yeah", "ok", "table", "Mm-hmm!"]), round(r.uniform(t, end), 3), 0.0))
            t = end
    return intervals, words + words[:5]


def plain_label(own, other, words, t, tau, th):
    h = t + tau / 1000.0
    turn = min(((s, i, e) for i, s, e in own if s <= t <= e), default=None)
    if turn is None:
        return None
    first, back, voiced = None, False, False
    for _, s, e in other:
        if s <= t + 1.6 and e >= t:
            c, end = max(s, t), min(e, h)
            n = [w for w, at in words if c <= at <= end]
            o = sum(not labelling_token(w) for w in n)
            d = (end - c) * 1000.0
            voiced |= s <= h <= e
            if c < end:
                if d >= th.substantive_ms or len(n) >= th.substantive_words or o > 0:
                    first = c if first is None else min(first, c)
                back |= d <= th.backchannel_ms and (len(n) <= th.backchannel_words or o == 0)
    a = any(s <= h <= e for _, s, e in own)
    if first is not None:
        return 1 if turn[2] <= first + th.yield_tolerance_s else 4 if not voiced and a else 3
    return 2 if a and back else 0 if a else 5


def labelling_token(w):
    return w.lower().strip("!") in ("yeah", "ok", "mm-hmm")


def test_labels_from_the_index_equal_plain_ones(spark):
    r = random.Random(8)
    intervals, words = conversation(r)
    iv = spark.createDataFrame(intervals, "file_id string, seg_idx int, start_s double, end_s double")
    wd = spark.createDataFrame(words, "file_id string, word string, start_s double, end_s double")
    manifest = spark.createDataFrame([("i0", "f0", "f1", "train", 90.0), ("i1", "f2", "f3", "val", 60.0)], "interaction_id string, file_id_a string, file_id_b string, split string, duration_s double")
    got = {(x.file_id, x.t_ms, x.tau_ms): x.label for x in labelling.label_windows(manifest, iv, wd).collect()}
    own, said, th = defaultdict(list), defaultdict(list), labelling.Thresholds()
    for f, i, s, e in intervals:
        own[f].append((i, s, e))
    for f, w, s, _ in words:
        said[f].append((w, s))
    want = {}
    for a, b, duration in (("f0", "f1", 90.0), ("f1", "f0", 90.0), ("f2", "f3", 60.0), ("f3", "f2", 60.0)):
        i = 0
        while 2.0 + i * 0.5 <= duration - 1.6:
            for tau in labelling.TAUS:
                label = plain_label(own[a], own[b], said[b], 2.0 + i * 0.5, tau, th)
                if label is not None:
                    want[a, round((2.0 + i * 0.5) * 1000), tau] = label
            i += 1
    assert got == want and len(set(want.values())) == 6


def test_the_index_is_not_moved(spark):
    """No exchange stands above the scan of the stored index, and filters on splits reach the manifest."""
    intervals, words = conversation(random.Random(1))
    iv = spark.createDataFrame(intervals, "file_id string, seg_idx int, start_s double, end_s double")
    wd = spark.createDataFrame(words, "file_id string, word string, start_s double, end_s double")
    manifest = spark.createDataFrame([("i0", "f0", "f1", "train", 90.0)] * 3, "interaction_id string, file_id_a string, file_id_b string, split string, duration_s double")
    index = timeindex.stored(timeindex.time_index(iv, wd, 1.6))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        labels = labelling.label_windows(manifest, None, None, index=index)
        plan = labels._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-*(0123456789)"))
    scans = [i for i, x in enumerate(lines) if "FileScan parquet" in x]
    assert len(scans) == 2 and plan.count("Exchange hashpartitioning") == 2
    for i in scans:
        above, at = [], depth(lines[i])
        for x in reversed(lines[:i]):
            if depth(x) < at:
                above.append(x)
                at = depth(x)
        joins = next(k for k, x in enumerate(above) if "Join" in x)
        assert not any("Exchange" in x for x in above[:joins])


# --- running sums of lagged products ------------------------------------------------------------


@pytest.mark.parametrize("win,stride,lag", [(20, 4, 10), (12, 1, 3), (64, 16, 10), (9, 8, 10)])
def test_pearson_by_running_sums_equals_slices(spark, win, stride, lag):
    r = random.Random(win)
    rows = []
    for w in range(4):
        for f in range(3):
            for t in range(100 if w else 7):
                constant = f == 1 and 30 <= t < 70
                x = 5.0 if constant else 1e3 * f + r.gauss(0, 1) * (1e-9 if f == 2 and t > 60 else 1)
                rows.append((w, t * 2, f, x, math.sin(t / 5) + 0.1 * x if w != 2 else 1.0))
    df = spark.createDataFrame(rows, "window_id long, frame int, feature int, x double, y double").cache()
    key = lambda x: (x.window_id, x.sub, x.feature, x.lag)
    sums = {key(x): x["corr"] for x in signals._pearson_by_sums(df, win, stride, lag).collect()}
    slices = {key(x): x["corr"] for x in signals._pearson_by_slices(df, win, stride, lag).collect()}
    assert sums.keys() == slices.keys()
    assert max(abs(sums[k] - slices[k]) for k in sums) < 1e-9
    assert statistics.median(abs(sums[k] - slices[k]) for k in sums) < 1e-12


# --- runs over partitions -----------------------------------------------------------------------

WIN = "window_id long, file_id string, start_s double, end_s double, label int, mean_max_abs_corr double, mean_abs_zero_lag_corr double, mean_best_lag_sec double, speaker_lead_ratio double, listener_lead_ratio double"


@pytest.mark.parametrize("partition", [(), ("file_id",)])
def test_runs_that_span_partitions(spark, partition):
    r = random.Random(3)
    rows, n = [], 0
    for f in range(3):
        for i in range(150):
            label = 0 if f == 1 else int(i / r.choice([3, 40]))  # file 1 is one run through all partitions
            rows.append((n, f"f{f}" if r.random() > 0.01 or f == 1 else None, 1000.0 * f + 2 * i, 1000.0 * f + 2 * i + (2 if f == 1 or i % 17 else 1), label, 0.5, 0.1, 0.0, 1.0, 0.0))
            n += 1
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        got = signals.label_segments(spark.createDataFrame(rows, WIN).repartition(3), partition).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want, last, number = [], None, Counter()
    for x in sorted(rows, key=lambda x: ((x[1] or "") if partition else "", x[2], x[3], x[0])):
        k = x[1] if partition else ""
        if last is None or last[0] != k or last[1] != x[4] or last[2] != x[2]:
            number[k] += 1
            want.append([k, number[k], x[4], x[2], x[3], 0])
        want[-1][4], want[-1][5] = max(want[-1][4], x[3]), want[-1][5] + 1
        last = (k, x[4], x[3])
    assert Counter((x.file_id if partition else "", x.segment_id, x.label, x.start_s, x.end_s, x.n_windows) for x in got) == Counter(map(tuple, want))
    assert max(x[5] for x in want) == 150


# --- first rows ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 7, 1_500, 10_000])
def test_first_rows_of_groups(spark, n):
    df = spark.range(6_000).select(F.when(F.col("id") % 4 > 0, "hot").when(F.col("id") % 8 > 0, "b").alias("split"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"), "id").repartition(6)
    rows = defaultdict(list)
    for x in df.collect():
        rows[x.split].append((x.v, x.id))
    got = Counter((x.split, x.v, x.id) for x in topn.first_n(df, ["split"], ["v", "id"], n).collect())
    assert got == Counter((s, *x) for s, v in rows.items() for x in sorted(v)[:n])
    ranked = reports.cap_per_split(df, n, "id")
    hashed = defaultdict(list)
    for x in df.withColumn("h", F.xxhash64("id", F.lit(42))).collect():
        hashed[x.split].append((x.h, x.id))
    assert Counter((x.split, x.id) for x in ranked.collect()) == Counter((s, i) for s, v in hashed.items() for _, i in sorted(v)[:n])


def test_tasks_keep_n_rows_before_the_shuffle(spark):
    df = spark.range(1_000).select((F.col("id") % 2).alias("g"), "id")
    plan = topn.first_n(df, ["g"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


# --- label files --------------------------------------------------------------------------------

KEYS = ["a_t_0002000", 'q"uote, "x": 3', "back\\slash", "comma, 1, 2", "é, ü", "tab\t", "{brace}: [1]", ", ", "", " led", '"', "{ "]


@pytest.mark.parametrize("dump", [{}, {"indent": 2}, {"indent": 2, "sort_keys": True}, {"separators": (",", ":")}, {"indent": 4, "ensure_ascii": False}])
def test_label_objects_of_any_layout(spark, tmp_path, dump):
    held = {k: i % 6 for i, k in enumerate(KEYS)} | {f"k{i}": i % 6 for i in range(300)}
    (tmp_path / "labels.json").write_text(json.dumps(held, **dump))
    got = readers.read_labels(spark, str(tmp_path / "labels.json"), 400).collect()
    assert Counter((x.sample_key, x.label) for x in got) == Counter(held.items())


def test_keys_that_end_like_a_cut_are_read_whole(spark, tmp_path):
    held = {"x,": 1, "y, ": 2, "z": 3, 'u,"': 4, "w": 0}
    for name, dump in (("a", {}), ("b", {"separators": (",", ":")}), ("c", {"indent": 2})):
        (tmp_path / f"{name}.json").write_text(json.dumps(held, **dump))
        assert {x.sample_key: x.label for x in readers.read_labels(spark, str(tmp_path / f"{name}.json"), 1).collect()} == held


@pytest.mark.parametrize("text", ['{"a": 6}', '{"a": "x", "b": 1}', '{"a": 1.5}', "[1, 2]", '{"a": null}', '{"a": 1, "b": {"c": 2}}'])
def test_bad_labels_are_errors(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="bad label|JSON object"):
        readers.read_labels(spark, str(tmp_path / "bad.json"), 400).collect()


def test_an_empty_object_has_no_labels(spark, tmp_path):
    (tmp_path / "none.json").write_text("{}\n")
    assert readers.read_labels(spark, str(tmp_path / "none.json"), 400).count() == 0


def test_one_line_is_read_by_several_tasks(spark, tmp_path):
    held = {f"file{i:07d}_t_{i:07d}": i % 6 for i in range(120_000)}
    (tmp_path / "big.json").write_text(json.dumps(held))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        df = readers.read_labels(spark, str(tmp_path / "big.json"), 400)
        tasks = df.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) >= 8 and df.count() == len(held)
        assert df.agg(F.sum("label")).first()[0] == sum(held.values()) and df.select("sample_key").distinct().count() == len(held)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_an_object_is_written_in_key_order_by_several_tasks(spark, tmp_path):
    rows = [(k, tau, i % 6) for tau in (200, 400) for i, k in enumerate(KEYS + [f"k{j:05d}" for j in range(2_000)])]
    sinks.write_labels(spark.createDataFrame(rows, "sample_key string, tau_ms int, label int").repartition(5), str(tmp_path), fmt="object")
    for tau in (200, 400):
        parts = sorted((tmp_path / f"tau_ms={tau}").glob("part-*"))
        held = json.loads("".join(p.read_text() for p in parts))
        assert len(parts) > 1 and held == {k: v for k, t, v in rows if t == tau} and list(held) == sorted(held, key=lambda k: k.encode())
        got = readers.read_labels(spark, str(tmp_path / f"tau_ms={tau}"), tau).collect()
        assert Counter((x.sample_key, x.label) for x in got) == Counter(held.items())


# --- the label store, provenance ----------------------------------------------------------------


def test_filters_prune_the_label_store(spark, tmp_path):
    rows = [(f"k{i}", s, t, i % 6) for i in range(20) for s in ("train", "val") for t in (200, 400)]
    sinks.write_label_store(spark.createDataFrame(rows, "sample_key string, split string, tau_ms int, label int"), str(tmp_path))
    store = sinks.read_label_store(spark, str(tmp_path), ["sample_key", "split", "tau_ms", "label"])
    some = filters.split_filter(store, "val").where("tau_ms = 400")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "tau_ms" in plan.split("PartitionFilters")[1].split("]")[0]
    assert some.count() == 20 and all("split=val/tau_ms=400" in x.f for x in some.select(F.input_file_name().alias("f")).collect())
    chosen = spark.createDataFrame([("val", 200)], "s string, t int").where("t > 0")
    joined = store.join(F.broadcast(chosen), (F.col("split") == F.col("s")) & (F.col("tau_ms") == F.col("t")))
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 20


def test_provenance_is_one_document(spark, tmp_path):
    counts = spark.createDataFrame([(400, "train", 3), (200, "val", 5)], "tau_ms int, split string, n long")
    dyads = spark.createDataFrame([(f"i{k:03d}", k % 2 == 0) for k in range(100)], "interaction_id string, transcript boolean").repartition(6)
    path = str(tmp_path / "run")
    sinks.write_run_manifest({"stride_ms": "500"}, counts, dyads, path, {0: "hold", 1: "yield"}, ("yeah", "ok"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "run" / "document").glob("part-*")))
    doc = json.loads(text)
    assert doc["config"] == {"stride_ms": "500"} and doc["class_names"] == {"0": "hold", "1": "yield"} and doc["lexicon"] == ["yeah", "ok"]
    assert doc["counts"][:-1] == [{"tau_ms": 200, "split": "val", "n": 5}, {"tau_ms": 400, "split": "train", "n": 3}]
    assert [d["interaction_id"] for d in doc["dyads"][:-1]] == [f"i{k:03d}" for k in range(100)]
    head, c, d = sinks.read_run_manifest(spark, path, "tau_ms int, split string, n long", "interaction_id string, transcript boolean")
    assert head["lexicon"] == ["yeah", "ok"] and c.count() == 2 and d.where("transcript").count() == 50


# --- training, commits, sidecars ----------------------------------------------------------------


def clouds(spark, n=300, seed=0, noise=1.0):
    r = np.random.default_rng(seed)
    y = r.integers(0, 3, n)
    x = r.normal(size=(n, 4)) * noise + np.eye(3, 4)[y] * 3 + 100
    return spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(n)], "features array<double>, label int")


def test_training_stops_and_keeps_the_best_epoch(spark):
    train, val = clouds(spark, 300, 1, 2.0), clouds(spark, 200, 2, 2.0)
    model = models.train_classifier(train, val, seed=5, epochs=30, patience=3)
    again = models.train_classifier(train.repartition(3), val, seed=5, epochs=30, patience=3)
    assert np.allclose(model.weights, again.weights, atol=1e-8) and [h[0] for h in model.history] == list(range(1, len(model.history) + 1))
    history = model.history_frame(spark).withColumn("run", F.lit(1))
    best, stop = reports.best_epoch(history, "macro_f1", ["run"]).first(), reports.early_stop_epoch(history, "macro_f1", ["run"], 3).first()
    assert (best.best_epoch, stop.stop_epoch) == (model.best_epoch, model.stop_epoch) and stop.stopped
    # the weights are those of the best epoch: their validation score is its entry in the history
    scored = models.predict_records(model, val)
    score = metrics.macro_metrics(metrics.per_class_metrics(scored.select("label", "pred"), 3)).first().macro_f1
    assert score == pytest.approx(model.history[model.best_epoch - 1][1], abs=1e-9) and score > 0.6


def test_gradients_match_a_plain_step(spark):
    """One epoch of a weighted problem against numpy."""
    df = clouds(spark, 50, 3)
    weights = spark.createDataFrame([(0, 1.0), (1, 0.5), (2, 0.0)], "label int, weight double")
    model = models.train_classifier(df, None, weights=weights, seed=1, epochs=1)
    x, y = np.array([r.features for r in df.collect()]), np.array([r.label for r in df.collect()])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    theta = np.random.default_rng(1).normal(scale=0.01, size=(3, 5))
    p = np.exp(z @ theta.T)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(50), y] -= 1
    w = np.array([1.0, 0.5, 0.0])[y]
    g = (p * w[:, None]).T @ z / w.sum()
    g[:, :-1] += 0.01 * theta[:, :-1]
    stepped = theta - 0.3 * g / (np.abs(g) + 1e-8)
    plain = stepped[:, :-1] / scale
    assert np.allclose(model.weights, np.column_stack([plain, stepped[:, -1] - plain @ mean]), atol=1e-6)


def test_training_without_rows_is_an_error(spark):
    with pytest.raises(ValueError, match="no rows"):
        models.train_classifier(clouds(spark).limit(0))


def block(spark):
    frames = spark.createDataFrame([(w, s, 0, 0, float(w % 3) + (s == "listener")) for w in range(90) for s in ("speaker", "listener")], "window_id long, stream string, frame int, feature int, value double")
    samples = spark.createDataFrame([(f"k{w}", w, ("train", "train", "val", "test")[w % 4]) for w in range(90)], "sample_key string, window_id long, split string")
    labels = spark.createDataFrame([(f"k{w}", tau, w % 3) for w in range(90) for tau in (100, 200, 400, 800)], "sample_key string, tau_ms int, label int")
    return frames, samples, labels


def test_a_failure_keeps_whole_taus_and_a_rerun_goes_on(spark, tmp_path, monkeypatch):
    path, commit, trained = str(tmp_path), models.commit_results, []

    def fails_at_the_third(rows, at, experiment, tau):
        if tau == 400:
            raise RuntimeError("stopped")
        commit(rows, at, experiment, tau)

    monkeypatch.setattr(models, "commit_results", fails_at_the_third)
    with pytest.raises(RuntimeError):
        models.ablation_block({"one": ("speaker",)}, *block(spark), path=path)
    assert sinks.commits(spark, path) == [("one", 100), ("one", 200)]
    assert sorted(x.tau_ms for x in sinks.read_committed(spark, path).collect()) == [100, 200]

    def counted(rows, at, experiment, tau):
        trained.append((experiment, tau))
        commit(rows, at, experiment, tau)

    monkeypatch.setattr(models, "commit_results", counted)
    out = models.ablation_block({"one": ("speaker",), "two": ("listener",)}, *block(spark), path=path, evaluate=("test", "val"))
    assert trained == [("one", 400), ("one", 800)] + [("two", t) for t in (100, 200, 400, 800)]
    assert Counter(x.experiment for x in out.where("split = 'test'").collect()) == {"one": 4, "two": 4}
    trained.clear()
    models.ablation_block({"one": ("speaker",), "two": ("listener",)}, *block(spark), path=path)
    assert trained == []


def test_uncommitted_rows_are_not_read(spark, tmp_path):
    rows = spark.createDataFrame([("one", 100, 0.5)], "experiment string, tau_ms int, macro_f1 double")
    sinks.commit_results(rows, str(tmp_path), "one", 100)
    rows.drop("experiment", "tau_ms").write.parquet(str(tmp_path / "results/experiment=one/tau_ms=200"))
    assert [x.tau_ms for x in sinks.read_committed(spark, str(tmp_path)).collect()] == [100]
    assert sinks.read_committed(spark, str(tmp_path / "nowhere")) is None


def test_only_what_changed_is_redone(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([(f"{d:03d}", w, d * w) for d in range(5) for w in range(4)], "dyad string, w int, v int")

    def run(inputs, params, output):
        plan = filters.resume_plan(filters.fingerprints(inputs, "dyad", params), sinks.read_sidecars(spark, path, "dyad"), "dyad").cache()
        todo = plan.where("reason <> 'done'")
        work = output(inputs.join(todo.select("dyad"), "dyad", "left_semi"))
        reasons = {x.dyad: x.reason for x in plan.collect()}
        if todo.count():
            sinks.write_with_sidecars(work, todo, path, "dyad")
        return reasons

    total = lambda df: df.groupBy("dyad").agg(F.sum("v").alias("total"))
    assert set(run(rows, {"win": "2"}, lambda df: total(df).where("dyad <> '004'")).values()) == {"no_sidecar"}
    assert run(rows, {"win": "2"}, total) == {"000": "done", "001": "done", "002": "done", "003": "done", "004": "empty_output"}
    assert set(run(rows.orderBy(F.desc("v")), {"win": "2"}, total).values()) == {"done"}
    changed = rows.where("NOT (dyad = '001' AND w = 2)").unionByName(rows.where("dyad = '002' AND w = 1"))
    assert run(changed, {"win": "2"}, total) == {"000": "done", "001": "changed_input", "002": "changed_input", "003": "done", "004": "done"}
    assert {x.dyad: x.total for x in spark.read.schema("total long, dyad string").parquet(f"{path}/data").collect()} == {"000": 0, "001": 4, "002": 14, "003": 18, "004": 24}
    assert set(run(changed, {"win": "3"}, total).values()) == {"changed_parameter"}


def stored(spark, path):
    data = spark.read.parquet(f"{path}/data").groupBy("k").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    side = sinks.read_sidecars(spark, path, "k")
    return {x.k: (x.v, x.n) for x in data.collect()}, {x.k: (x.fingerprint, x.n_rows) for x in side.collect()}


def of_keys(spark, keys, v):
    rows = spark.createDataFrame([(f"{k:05d}", v + i) for k in keys for i in range(2)], "k string, v int")
    return rows, spark.createDataFrame([(f"{k:05d}", f"f{v}", "{}") for k in keys], "k string, fingerprint string, params string")


def test_files_of_a_store_do_not_grow_with_its_keys(spark, tmp_path):
    """3,000 keys, then 300 of them and 10 new ones; 50 of those have no output any more."""
    path = str(tmp_path)
    sinks.write_with_sidecars(*of_keys(spark, range(3_000), 10), path, "k")
    rows, prints = of_keys(spark, [*range(300), *range(3_000, 3_010)], 20)
    sinks.write_with_sidecars(rows.where("k >= '00050'"), prints, path, "k")
    data, side = stored(spark, path)
    changed = lambda k: k < 300 or k >= 3_000
    assert data == {f"{k:05d}": (41, 2) if changed(k) else (21, 2) for k in range(50, 3_010)}
    assert side == {f"{k:05d}": ("f20" if changed(k) else "f10", 0 if k < 50 else 2) for k in range(3_010)}
    assert len(list(tmp_path.rglob("part-*"))) < 1_500
    assert not (tmp_path / "staged").exists()


def test_an_interrupted_store_redoes_one_folder_at_most(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    sinks.write_with_sidecars(*of_keys(spark, range(1_000), 10), path, "k")
    swap, swapped = sinks._swap_bucket, []

    def stops(spark, staged, path, bucket):
        if len(swapped) == 20:
            shutil.rmtree(f"{path}/sidecars/_bucket={bucket}")
            raise RuntimeError("stopped")
        swapped.append(bucket)
        swap(spark, staged, path, bucket)

    monkeypatch.setattr(sinks, "_swap_bucket", stops)
    with pytest.raises(RuntimeError):
        sinks.write_with_sidecars(*of_keys(spark, range(1_000), 20), path, "k")
    data, side = stored(spark, path)
    gone = set(data) - set(side)
    assert 0 < len(gone) < 60 and len(data) == 1_000
    assert all((f == "f20") == (data[k] == (41, 2)) for k, (f, _) in side.items()) and {f for f, _ in side.values()} == {"f10", "f20"}
    monkeypatch.undo()
    sinks.write_with_sidecars(*of_keys(spark, [int(k) for k in gone], 20), path, "k")
    assert len(stored(spark, path)[1]) == 1_000


# --- components, tables that go ------------------------------------------------------------------


def tables_of(spark):
    return set(os.listdir(graphs.shared_folder(spark).removeprefix("file://")))


@pytest.mark.parametrize("seed", range(4))
def test_components_leave_when_finished(spark, seed):
    """Chains, stars, cliques and random parts of very different size, with nodes in random order."""
    r = random.Random(seed)
    names = list(range(3_000))
    r.shuffle(names)
    edges, at = [], 0
    while at < 2_900:
        n = r.choice([1, 2, 2, 3, 5, 40, 700])
        part = names[at : at + n]
        n = len(part)
        at += n
        kind = r.randrange(3)
        edges += [(part[0], part[0])] if n == 1 else [(a, b) for a, b in zip(part, part[1:])] if kind == 0 else [(part[0], x) for x in part[1:]] if kind == 1 else [(part[i], part[r.randrange(i)]) for i in range(1, n)]
    edges += edges[:50] + [(None, 3), (3, None)]
    root = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    before = tables_of(spark)
    got = graphs.connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(3))
    left = tables_of(spark) - before
    assert Counter((x.node, x.component) for x in got.collect()) == Counter((x, find(x)) for x in root)
    assert 1 <= len(left) <= 12  # what each round finished, and nothing else


def test_a_block_deletes_what_it_wrote(spark):
    before = tables_of(spark)
    with graphs.scratch(spark) as keep:
        a = graphs.written(spark.range(5))
        with graphs.scratch(spark) as inner:
            b = inner(a.selectExpr("id + 1 AS id"))
        kept = keep(b.unionByName(graphs.written(a)))
    assert sorted(x.id for x in kept.collect()) == [0, 1, 1, 2, 2, 3, 3, 4, 4, 5]
    assert len(tables_of(spark) - before) == 1
    graphs.discard(kept)
    assert tables_of(spark) == before
    with pytest.raises(ValueError), graphs.scratch(spark):
        graphs.written(spark.range(1))
        raise ValueError
    assert tables_of(spark) == before
