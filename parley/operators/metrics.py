"""Counts, weights and classification metrics. Predictions are reduced to cells first: one row
per group, true and predicted class, so that everything after it is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import written
from .medians import with_medians
from .small import few


def summarize_samples(samples: DataFrame) -> DataFrame:
    """Counts in total, per split, per class and per both (null where not grouped)."""
    return samples.cube("split", "label").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def class_weights(samples: DataFrame, k: int = 3) -> DataFrame:
    """``label, weight`` = total / (k * n) for the classes 0..k-1; 0 for an absent class.

    ``total`` counts all labels given; without samples there is no row.
    """
    n = samples.groupBy("label").agg(F.count("*").alias("n"))
    classes = samples.sparkSession.range(k).select(F.col("id").cast("int").alias("label"))
    total = n.agg(F.sum("n").alias("total")).where("total > 0")
    weight = F.when(F.col("n") > 0, F.col("total") / (k * F.col("n"))).otherwise(0.0)
    return F.broadcast(classes).join(n.withColumn("label", F.col("label").cast("int")), "label", "left").crossJoin(F.broadcast(total)).select("label", weight.alias("weight"))


def cells(preds: DataFrame, by: list[str]) -> DataFrame:
    return preds.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(preds: DataFrame, k: int = 3, by: list[str] | None = None) -> DataFrame:
    """Rows are true classes, ``pred_c`` columns predicted ones; classes outside 0..k-1 are ignored."""
    by = by or []
    inside = preds.where(F.col("label").between(0, k - 1) & F.col("pred").between(0, k - 1))
    counts = [F.count(F.when((F.col("label") == t) & (F.col("pred") == p), 1)).alias(f"c{t}{p}") for t in range(k) for p in range(k)]
    rows = F.array(*[F.struct(F.lit(t).alias("label"), *[F.col(f"c{t}{p}").alias(f"pred_{p}") for p in range(k)]) for t in range(k)])
    return inside.groupBy(*by).agg(*counts).select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def per_class_from_cells(c: DataFrame, k: int, by: list[str]) -> DataFrame:
    n, t, p = F.col("n"), F.col("label"), F.col("pred")
    sums = []
    for i in range(k):
        sums += [F.sum(F.when((t == i) & (p == i), n).otherwise(0)).alias(f"tp{i}"), F.sum(F.when((t != i) & (p == i), n).otherwise(0)).alias(f"fp{i}"), F.sum(F.when((t == i) & (p != i), n).otherwise(0)).alias(f"fn{i}")]
    rows = F.array(*[F.struct(F.lit(i).alias("class"), *[F.coalesce(F.col(f"{x}{i}"), F.lit(0)).cast("long").alias(x) for x in ("tp", "fp", "fn")]) for i in range(k)])
    long = c.groupBy(*by).agg(*sums).select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    rated = long.select("*", (tp + fn).alias("support"), precision.alias("precision"), recall.alias("recall"))
    return rated.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def per_class_metrics(preds: DataFrame, k: int = 3, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, support, precision, recall and F1 of each class 0..k-1; 0/0 is 0."""
    return per_class_from_cells(cells(preds, by or []), k, by or [])


def macro_metrics(per_class: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro precision, recall, F1 over all classes, and F1 weighted by support."""
    return per_class.groupBy(*(by or [])).agg(
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("n"),
    )


def accuracy_balanced(preds: DataFrame, k: int = 3, by: list[str] | None = None) -> DataFrame:
    """Accuracy, and balanced accuracy (macro recall)."""
    by = by or []
    per = per_class_metrics(preds, k, by)
    return per.groupBy(*by).agg(_ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"))


GROUP_KEYS = ("interaction_id", "speaker", "relationship", "relationship_detail")


def grouped_metrics(preds: DataFrame, keys: tuple[str, ...] = GROUP_KEYS, k: int = 3, by: list[str] | None = None) -> DataFrame:
    """Macro metrics per value of each key, from one pass; always over all k classes."""
    by = by or []
    base = cells(preds, [*by, *keys])
    kinds = F.array(*[F.struct(F.lit(x).alias("group_kind"), F.col(x).cast("string").alias("group_value")) for x in keys])
    long = base.select(*by, "label", "pred", "n", F.explode(kinds).alias("g")).select(*by, "label", "pred", "n", "g.*")
    groups = [*by, "group_kind", "group_value"]
    summed = long.groupBy(*groups, "label", "pred").agg(F.sum("n").alias("n"))
    return macro_metrics(per_class_from_cells(summed, k, groups), groups)


def grouped_class_metrics(preds: DataFrame, keys: tuple[str, ...] = GROUP_KEYS, k: int = 3, by: list[str] | None = None) -> DataFrame:
    """Per value of each key and true class: its row of the confusion matrix (``pred_c``), and its scores.

    Cells are counted once for all keys; what follows is one row per group, true and predicted class.
    """
    by = by or []
    base = cells(preds.where(F.col("label").between(0, k - 1) & F.col("pred").between(0, k - 1)), [*by, *keys])
    kinds = F.array(*[F.struct(F.lit(x).alias("group_kind"), F.col(x).cast("string").alias("group_value")) for x in keys])
    groups = [*by, "group_kind", "group_value"]
    summed = base.select(*by, "label", "pred", "n", F.explode(kinds).alias("g")).select(*by, "label", "pred", "n", "g.*").groupBy(*groups, "label", "pred").agg(F.sum("n").alias("n"))
    tp, n = [F.col(c) for c in ("tp", "n")]
    count = lambda t, p: F.coalesce(F.sum(F.when((F.col("label") == t) & (F.col("pred") == p), n)), F.lit(0)).cast("long")
    wide = summed.groupBy(*groups).agg(*[count(t, p).alias(f"c{t}{p}") for t in range(k) for p in range(k)])
    total = lambda names: sum((F.col(x) for x in names[1:]), F.col(names[0]))
    rows = [F.struct(F.lit(t).alias("class"), *[F.col(f"c{t}{p}").alias(f"pred_{p}") for p in range(k)], F.col(f"c{t}{t}").alias("tp"), total([f"c{t}{p}" for p in range(k)]).alias("support"), total([f"c{x}{t}" for x in range(k)]).alias("predicted")) for t in range(k)]
    long = wide.select(*groups, F.explode(F.array(*rows)).alias("x")).select(*groups, "x.*")
    scored = long.select("*", _ratio(tp, F.col("predicted")).alias("precision"), _ratio(tp, F.col("support")).alias("recall")).drop("predicted", "tp")
    return scored.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def group_metric_spread(grouped: DataFrame, metric: str = "macro_f1", by: tuple[str, ...] = ("group_kind",)) -> DataFrame:
    """Mean, sample standard deviation, extremes and exact median of a metric over groups."""
    rows, m = written(grouped.select(*by, metric)), F.col(metric)
    plain = rows.groupBy(*by).agg(F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"), F.min(m).alias("min"), F.max(m).alias("max"), F.count("*").alias("n_groups"))
    return with_medians(plain, rows, list(by), {"median": metric})


def class_distribution(df: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), label).agg(F.count("*").alias("n"))


#: The least probability that a log-loss takes.
LEAST = 1e-15


def weighted_log_loss(preds: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of w * -ln p(true class) over the sum of w; ``probs`` is an array by class.

    Probabilities are ``LEAST`` at least, so that a wrong certainty counts and is finite.
    """
    w = preds.join(weights.select(F.col("label").alias("_l"), "weight"), F.col("label") == F.col("_l"))
    p = F.get(F.col("probs"), F.col("label").cast("int"))
    return w.groupBy(*(by or [])).agg((F.sum(F.col("weight") * -F.log(F.greatest(p, F.lit(LEAST)))) / F.sum("weight")).alias("loss"))


def coordination_by_label(rows: DataFrame, columns: list[str], classes: tuple[int, ...] | None = None) -> DataFrame:
    """Rows and the mean of each existing column per label; rows without a label are dropped."""
    have = [c for c in columns if c in rows.columns]
    kept = rows.where(F.col("label").isNotNull() if classes is None else F.col("label").isin(*classes))
    return kept.groupBy("label").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in have])


#: Output column, window statistic, aggregate.
_LABEL_SUMMARY = (
    ("mean_peak_corr", "mean_max_abs_corr", "avg"), ("std_peak_corr", "mean_max_abs_corr", "stddev_samp"), ("median_peak_corr", "mean_max_abs_corr", "median"),
    ("mean_global_peak_corr", "global_peak_abs_corr", "avg"), ("median_global_peak_corr", "global_peak_abs_corr", "median"),
    ("mean_zero_lag_abs_corr", "mean_abs_zero_lag_corr", "avg"), ("std_zero_lag_abs_corr", "mean_abs_zero_lag_corr", "stddev_samp"), ("mean_zero_lag_signed_corr", "mean_zero_lag_corr", "avg"),
    ("mean_best_lag_frames", "mean_best_lag_frames", "avg"), ("std_best_lag_frames", "mean_best_lag_frames", "stddev_samp"), ("mean_abs_best_lag_frames", "mean_abs_best_lag_frames", "avg"),
    ("mean_best_lag_sec", "mean_best_lag_sec", "avg"), ("std_best_lag_sec", "mean_best_lag_sec", "stddev_samp"), ("mean_abs_best_lag_sec", "mean_abs_best_lag_sec", "avg"),
    ("mean_speaker_lead_ratio", "speaker_lead_ratio", "avg"), ("mean_listener_lead_ratio", "listener_lead_ratio", "avg"), ("mean_zero_lag_ratio", "zero_lag_ratio", "avg"), ("mean_high_sync_ratio", "high_sync_ratio", "avg"),
)
_VIDEO_LABEL = ("mean_peak_corr", "median_peak_corr", "mean_zero_lag_abs_corr", "mean_best_lag_sec", "mean_abs_best_lag_sec", "mean_speaker_lead_ratio", "mean_listener_lead_ratio", "mean_zero_lag_ratio", "mean_high_sync_ratio")


def _summary(stats: DataFrame, by: list[str], first: list[Column], names: tuple[str, ...]) -> DataFrame:
    """The named statistics of a group; medians are found apart, as a group may hold all windows."""
    chosen = [x for x in _LABEL_SUMMARY if x[0] in names]
    rows = written(stats.select(*by, *sorted({c for _, c, _ in chosen})))
    plain = rows.groupBy(*by).agg(*first, *[getattr(F, f)(c).alias(out) for out, c, f in chosen if f != "median"])
    return with_medians(plain, rows, by, {out: c for out, c, f in chosen if f == "median"})


def coordination_label_summary(stats: DataFrame, window_s: float = 2.0) -> DataFrame:
    first = [F.count("*").alias("n_windows"), (F.lit(window_s) * F.count("*")).alias("total_duration_s")]
    return _summary(stats, ["label"], first, tuple(out for out, *_ in _LABEL_SUMMARY))


def coordination_video_label(stats: DataFrame) -> DataFrame:
    return _summary(stats, ["file_id", "label"], [F.count("*").alias("n_windows")], _VIDEO_LABEL)


def annotation_coverage(dyads: DataFrame, annotations: DataFrame) -> DataFrame:
    """``both``, ``single`` or ``none``: how many participants of a dyad have an annotation."""
    n = annotations.groupBy("interaction_id").agg(F.countDistinct("participant_id").alias("n"))
    kind = F.when(F.col("n") >= 2, "both").when(F.col("n") == 1, "single").otherwise("none")
    return dyads.join(n, "interaction_id", "left").select("interaction_id", kind.alias("annotation_coverage"))


def pool_summary(pool: DataFrame, splits: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows per split against the target, and per split and relationship (``relationship`` null in totals)."""
    joined = pool.join(splits, "interaction_id")
    per = joined.groupBy("split", "relationship").agg(F.count("*").alias("n"))
    total = joined.groupBy("split").agg(F.count("*").alias("n")).withColumn("relationship", F.lit(None).cast("string"))
    return per.unionByName(total).join(few(targets), "split", "left").select("split", "relationship", "n", "target")


def pool_report(pool: DataFrame, splits: DataFrame, targets: DataFrame, attributes: tuple[str, ...] = ("seamless_split", "relationship")) -> DataFrame:
    """``split, attribute, value, n, target``: the pool by its source splits, and every split in total
    and by each attribute. ``split`` is null for the pool, ``attribute`` and ``value`` for totals.

    One pass with grouping sets; the splits' targets are null where there is none.
    """
    joined = pool.join(splits, "interaction_id", "left")
    kinds = F.array(F.struct(F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    long = joined.select("split", F.explode(kinds).alias("k")).select("split", "k.*")
    inside = long.where("split IS NOT NULL").groupBy("split", "attribute", "value").agg(F.count("*").alias("n"))
    whole = long.where(F.col("attribute").isNull() | (F.col("attribute") == attributes[0])).groupBy("attribute", "value").agg(F.count("*").alias("n")).withColumn("split", F.lit(None).cast("string"))
    return inside.unionByName(whole).join(targets, "split", "left").select("split", "attribute", "value", "n", "target")


def component_histogram(components: DataFrame) -> DataFrame:
    """``size, n_components`` of components given as ``component, node`` rows."""
    return components.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_components"))


STATUSES = ("ok", "skipped", "dry", "missing", "failed")


def task_status_rollup(outcomes: DataFrame) -> DataFrame:
    """Per stream: tasks in each status, bytes and MiB."""
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}") for s in STATUSES]
    return outcomes.groupBy("stream").agg(F.count("*").alias("n"), *counts, F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).withColumn("mib", F.col("bytes") / (1024.0 * 1024.0))


def class_f1_across_runs(per_class: DataFrame) -> DataFrame:
    """Best and mean F1 of each class over experiments."""
    return per_class.groupBy("class").agg(F.max("f1").alias("best_f1"), F.avg("f1").alias("mean_f1"))


def run_index(results: DataFrame, train_tau: int = 400) -> DataFrame:
    """Per block: its experiments, the taus, and macro F1 at the training tau.

    ``results``: block, experiment, tau_ms, macro_f1.
    """
    at = F.max(F.when(F.col("tau_ms") == train_tau, F.col("macro_f1"))).alias("macro_f1_at_train_tau")
    per = results.groupBy("block", "experiment").agg(F.array_sort(F.collect_set("tau_ms")).alias("taus"), at)
    return per.groupBy("block").agg(
        F.count("*").alias("n_experiments"),
        F.array_join(F.array_sort(F.collect_list("experiment")), ",").alias("experiments"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("taus")))), ",").alias("taus"),
        F.max("macro_f1_at_train_tau").alias("best_macro_f1"),
    )


def run_experiments(results: DataFrame, runs: DataFrame, train_tau: int = 400) -> DataFrame:
    """Per block and experiment of a run: its configuration, epochs, and macro F1 at the training tau.

    ``results``: block, experiment, tau_ms, macro_f1; ``runs``: block, experiment, fusion, streams,
    n_params, best_epoch, epochs_run. An experiment without results at that tau has a null score.
    """
    at = results.where(F.col("tau_ms") == train_tau).groupBy("block", "experiment").agg(F.max("macro_f1").alias("macro_f1_at_train_tau"))
    return runs.join(at, ["block", "experiment"], "left").select("block", "experiment", "fusion", "streams", "n_params", "best_epoch", "epochs_run", "macro_f1_at_train_tau")
