"""Queries over the prediction fixture: metrics, curves, rankings, report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import metrics, reports, topn

from .fixtures import DUCKDB, ctes, fixture
from .registry import query

C = ctes(["c_preds"], DUCKDB)
BLOCKS = {"click": "c", "view": "v", "purchase": "p", "error": "e"}


def preds(spark, d):
    return fixture(spark, d, "c_preds")


def per_class_sql(source: str, by: list[str]) -> str:
    """CTEs ``pc`` (per class) and ``mac`` (macro) over ``source`` by the given columns."""
    g = "".join(f"{b}, " for b in by)
    return f"""cells AS (SELECT {g}label, pred, count(*) AS n FROM {source} GROUP BY ALL),
cls AS (SELECT unnest([0, 1, 2]) AS class),
raw AS (SELECT {g}class, CAST(sum(CASE WHEN label = class AND pred = class THEN n ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN label <> class AND pred = class THEN n ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN label = class AND pred <> class THEN n ELSE 0 END) AS BIGINT) AS fn FROM cells, cls GROUP BY ALL),
pr AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall FROM raw),
pc AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2e0 * precision * recall / (precision + recall) END AS f1 FROM pr),
mac AS (SELECT {g}avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, CASE WHEN sum(support) = 0 THEN 0e0 ELSE sum(f1 * support) / sum(support) END AS weighted_f1, CAST(sum(support) AS BIGINT) AS n FROM pc {"GROUP BY " + ", ".join(by) if by else ""})"""


def rounded(df, places: int = 9):
    """Doubles rounded, where the order of a sum may differ between engines."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(*columns: str, places: int = 9) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)


MACRO = ("macro_precision", "macro_recall", "macro_f1", "weighted_f1")


@query("confusion_matrix", C + " SELECT k.label, " + ", ".join(f"count(*) FILTER (pred = {p}) AS pred_{p}" for p in range(3)) + " FROM (SELECT unnest([0, 1, 2]) AS label) k LEFT JOIN c_preds c ON c.label = k.label GROUP BY 1")
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(preds(spark, d))


@query("per_class_metrics", C + ", " + per_class_sql("c_preds", ["tau_ms"]) + f" SELECT tau_ms, class, tp, fp, fn, support, {r('precision', 'recall', 'f1')} FROM pc")
def per_class_metrics(spark, d):
    return rounded(metrics.per_class_metrics(preds(spark, d), 3, ["tau_ms"]))


@query("macro_metrics", C + ", " + per_class_sql("c_preds", ["tau_ms"]) + f" SELECT tau_ms, n, {r(*MACRO)} FROM mac")
def macro_metrics(spark, d):
    return rounded(metrics.macro_metrics(metrics.per_class_metrics(preds(spark, d), 3, ["tau_ms"]), ["tau_ms"]))


@query("accuracy_balanced", C + ", " + per_class_sql("c_preds", ["experiment"]) + " SELECT experiment, round(CAST(sum(tp) AS DOUBLE) / sum(support), 9) AS accuracy, round(avg(recall), 9) AS balanced_accuracy FROM pc GROUP BY experiment")
def accuracy_balanced(spark, d):
    return rounded(metrics.accuracy_balanced(preds(spark, d), 3, ["experiment"]))


_LONG = ", long AS (" + " UNION ALL ".join(f"SELECT '{k}' AS group_kind, {k} AS group_value, label, pred FROM c_preds" for k in metrics.GROUP_KEYS) + ")"


@query("grouped_metrics", C + _LONG + ", " + per_class_sql("long", ["group_kind", "group_value"]) + f" SELECT group_kind, group_value, n, {r(*MACRO)} FROM mac")
def grouped_metrics(spark, d):
    return rounded(metrics.grouped_metrics(preds(spark, d)))


_GROUP_CLASS = C + _LONG + ", " + per_class_sql("long", ["group_kind", "group_value"]) + """, cm AS (SELECT group_kind, group_value, label AS class, """ + ", ".join(f"CAST(sum(CASE WHEN pred = {p} THEN n ELSE 0 END) AS BIGINT) AS pred_{p}" for p in range(3)) + """ FROM cells GROUP BY ALL)
SELECT group_kind, group_value, class, """ + ", ".join(f"coalesce(pred_{p}, 0) AS pred_{p}" for p in range(3)) + f", support, {r('precision', 'recall', 'f1')} FROM pc LEFT JOIN cm USING (group_kind, group_value, class)"


@query("grouped_class_metrics", _GROUP_CLASS)
def grouped_class_metrics(spark, d):
    return rounded(metrics.grouped_class_metrics(preds(spark, d)))


@query("group_metric_spread", C + _LONG + ", " + per_class_sql("long", ["group_kind", "group_value"]) + ' SELECT group_kind, round(avg(macro_f1), 9) AS "mean", round(stddev_samp(macro_f1), 9) AS std, round(min(macro_f1), 9) AS "min", round(max(macro_f1), 9) AS "max", round(median(macro_f1), 9) AS "median", count(*) AS n_groups FROM mac GROUP BY group_kind')
def group_metric_spread(spark, d):
    return rounded(metrics.group_metric_spread(metrics.grouped_metrics(preds(spark, d))))


@query("weighted_log_loss", C + ", w AS (SELECT label, (SELECT count(*) FROM c_preds) / (3e0 * count(*)) AS weight FROM c_preds GROUP BY label) SELECT tau_ms, round(sum(weight * -ln(CASE WHEN pred = label THEN 0.6e0 ELSE 0.2e0 END)) / sum(weight), 9) AS loss FROM c_preds JOIN w USING (label) GROUP BY tau_ms")
def weighted_log_loss(spark, d):
    p = preds(spark, d)
    probs = F.array(*[F.when(F.col("pred") == c, 0.6).otherwise(0.2) for c in range(3)])
    return rounded(metrics.weighted_log_loss(p.withColumn("probs", probs), metrics.class_weights(p), ["tau_ms"]))


# --- sweeps: macro metrics per experiment and tau ------------------------------------------------

SWEEP_SQL = C + ", " + per_class_sql("c_preds", ["experiment", "tau_ms"]) + ", sweep AS (SELECT * FROM mac)"
AUC_SQL = SWEEP_SQL + """, steps AS (SELECT *, (tau_ms - lag(tau_ms) OVER w) * (macro_f1 + lag(macro_f1) OVER w) / 2e0 AS a1, (tau_ms - lag(tau_ms) OVER w) * (macro_recall + lag(macro_recall) OVER w) / 2e0 AS a2 FROM sweep WINDOW w AS (PARTITION BY experiment ORDER BY tau_ms)),
auc AS (SELECT experiment, CASE WHEN count(*) > 1 THEN sum(a1) END AS auc_macro_f1, CASE WHEN count(*) > 1 THEN sum(a2) END AS auc_macro_recall, max(macro_f1) FILTER (tau_ms = 400) AS macro_f1_at_400, max(macro_recall) FILTER (tau_ms = 400) AS macro_recall_at_400 FROM steps GROUP BY experiment)"""
AUCS = ("auc_macro_f1", "auc_macro_recall")


def sweep(spark, d):
    return metrics.macro_metrics(metrics.per_class_metrics(preds(spark, d), 3, ["experiment", "tau_ms"]), ["experiment", "tau_ms"])


@query("rank_by_metric", SWEEP_SQL + " SELECT tau_ms, experiment, row_number() OVER (PARTITION BY tau_ms ORDER BY macro_f1 DESC, experiment) AS rank FROM sweep")
def rank_by_metric(spark, d):
    return reports.rank_by_metric(sweep(spark, d), "macro_f1", "experiment", ["tau_ms"]).select("tau_ms", "experiment", "rank")


@query("tau_auc", AUC_SQL + f" SELECT experiment, tau_ms, {r('auc_macro_f1', 'auc_macro_recall', places=6)} FROM sweep JOIN auc USING (experiment)")
def tau_auc(spark, d):
    return rounded(reports.with_tau_auc(sweep(spark, d), ("macro_f1", "macro_recall"), ["experiment"]).select("experiment", "tau_ms", *AUCS), 6)


@query("per_experiment_summary", AUC_SQL + f" SELECT experiment, substr(experiment, 1, 1) AS block, {r(*AUCS, 'macro_f1_at_400', 'macro_recall_at_400', places=6)} FROM auc")
def per_experiment_summary(spark, d):
    return rounded(reports.per_experiment_summary(sweep(spark, d).withColumn("block", F.substring("experiment", 1, 1)), ("block",)), 6)


@query("top_n_by_auc", AUC_SQL + " SELECT experiment, round(auc_macro_f1, 6) AS auc_macro_f1 FROM auc WHERE auc_macro_f1 IS NOT NULL ORDER BY auc_macro_f1 DESC, experiment LIMIT 3")
def top_n_by_auc(spark, d):
    return rounded(reports.top_n_by_auc(reports.tau_auc(sweep(spark, d), ("macro_f1",), ["experiment"]), "auc_macro_f1"), 6)


@query("tau_curves", AUC_SQL + f" SELECT experiment, tau_ms, {r('macro_f1', 'macro_recall')} FROM sweep WHERE experiment IN (SELECT experiment FROM auc WHERE auc_macro_f1 IS NOT NULL ORDER BY auc_macro_f1 DESC, experiment LIMIT 2)")
def tau_curves(spark, d):
    s = sweep(spark, d)
    return rounded(reports.tau_curves(s, reports.top_n_by_auc(reports.tau_auc(s, ("macro_f1",), ["experiment"]), "auc_macro_f1", 2), ("macro_f1", "macro_recall")))


T400 = ("macro_f1", "macro_recall", "macro_precision")
T400_SQL = C + ", " + per_class_sql("(SELECT * FROM c_preds WHERE tau_ms = 400)", ["experiment"]) + ", t400 AS (SELECT substr(experiment, 1, 1) AS block, * FROM mac)"


def t400(spark, d):
    p = preds(spark, d).where("tau_ms = 400")
    return metrics.macro_metrics(metrics.per_class_metrics(p, 3, ["experiment"]), ["experiment"]).withColumn("block", F.substring("experiment", 1, 1)).select("block", "experiment", *T400)


def _order(spark, d):
    e = preds(spark, d).select("experiment").distinct()
    return e.select(F.substring("experiment", 1, 1).alias("block"), "experiment", F.length("experiment").alias("position"))


_FLAG = ", ".join(f"{m} = max({m}) OVER (PARTITION BY block) AS is_max_{m}" for m in T400)


@query("block_table", T400_SQL + f" SELECT block, length(experiment) AS position, experiment, {_FLAG}, {r(*T400)} FROM t400")
def block_table(spark, d):
    return rounded(reports.block_table(t400(spark, d), _order(spark, d), T400))


@query("leaderboard", T400_SQL + " SELECT row_number() OVER (ORDER BY macro_f1 DESC, experiment) AS rank, block, experiment, " + ", ".join(f"{m} = max({m}) OVER () AS is_max_{m}" for m in T400) + f", {r(*T400)} FROM t400")
def leaderboard(spark, d):
    return rounded(reports.leaderboard(t400(spark, d), T400))


@query("ablation_suite", T400_SQL + " SELECT ascii(block) AS block_position, length(experiment) AS position, CASE WHEN row_number() OVER (PARTITION BY block ORDER BY length(experiment)) = 1 THEN upper(block) ELSE '' END AS block_cell, experiment, 'on ' || experiment AS streams, CASE WHEN block = 'c' THEN 'early' ELSE 'attention' END AS architecture FROM t400")
def ablation_suite(spark, d):
    o = _order(spark, d)
    titles = o.select("block", F.ascii("block").alias("block_position"), F.upper("block").alias("title")).distinct()
    named = t400(spark, d).withColumn("experiment_name", F.concat(F.lit("on "), "experiment")).withColumn("arch", F.when(F.col("block") == "c", "early").otherwise("attention"))
    return reports.ablation_suite(named, o, titles)


_HIST = C + ", h AS (SELECT experiment, day AS epoch, avg(value) AS f1 FROM c_preds GROUP BY ALL)"


def history(spark, d):
    return preds(spark, d).groupBy("experiment", F.col("day").alias("epoch")).agg(F.round(F.avg("value"), 9).alias("f1"))


@query("best_epoch", _HIST + " SELECT experiment, epoch AS best_epoch, round(f1, 9) AS best_value FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY round(f1, 9) DESC, epoch) AS k FROM h) WHERE k = 1")
def best_epoch(spark, d):
    return reports.best_epoch(history(spark, d), "f1", ["experiment"])


@query(
    "early_stop_epoch",
    _HIST
    + """, n AS (SELECT experiment, epoch, round(f1, 9) AS f1, row_number() OVER w AS k, max(round(f1, 9)) OVER (PARTITION BY experiment ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM h WINDOW w AS (PARTITION BY experiment ORDER BY epoch)),
s AS (SELECT *, k - max(CASE WHEN prev IS NULL OR f1 > prev THEN k END) OVER (PARTITION BY experiment ORDER BY epoch) AS since FROM n)
SELECT experiment, coalesce(min(epoch) FILTER (since >= 4), max(epoch)) AS stop_epoch, bool_or(since >= 4) AS stopped FROM s GROUP BY experiment""",
)
def early_stop_epoch(spark, d):
    return reports.early_stop_epoch(history(spark, d), "f1", ["experiment"])


@query("cap_per_split", "SELECT split, event_id, least(n, 500) AS n FROM (SELECT event_type AS split, event_id, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 500")
def cap_per_split(spark, d):
    """Which rows stay is shown with ids as the order; the hash order that the operator uses has no SQL form and is tested apart."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("split"), "event_id")
    kept = topn.first_n(e, ["split"], ["event_id"], 500)
    hashed = reports.cap_per_split(e, 500, "event_id").groupBy("split").agg(F.countDistinct("event_id").alias("n"))
    return kept.join(hashed, "split").select("split", "event_id", "n")


@query("class_f1_across_runs", C + ", " + per_class_sql("(SELECT * FROM c_preds WHERE tau_ms = 400)", ["experiment"]) + " SELECT class, round(max(f1), 9) AS best_f1, round(avg(f1), 9) AS mean_f1 FROM pc GROUP BY class")
def class_f1_across_runs(spark, d):
    return rounded(metrics.class_f1_across_runs(metrics.per_class_metrics(preds(spark, d).where("tau_ms = 400"), 3, ["experiment"])))


@query(
    "run_index",
    SWEEP_SQL + """ SELECT substr(experiment, 1, 1) AS block, count(DISTINCT experiment) AS n_experiments, array_to_string(list_sort(list_distinct(list(experiment))), ',') AS experiments, array_to_string(list_sort(list_distinct(list(tau_ms))), ',') AS taus, round(max(macro_f1) FILTER (tau_ms = 400), 9) AS best_macro_f1 FROM sweep GROUP BY 1""",
)
def run_index(spark, d):
    return rounded(metrics.run_index(sweep(spark, d).withColumn("block", F.substring("experiment", 1, 1))))


@query(
    "run_experiments",
    SWEEP_SQL + """, h AS (SELECT experiment, day AS epoch, round(avg(value), 9) AS f1 FROM c_preds GROUP BY ALL), best AS (SELECT experiment, epoch AS best_epoch FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY f1 DESC, epoch) AS k FROM h) WHERE k = 1), ep AS (SELECT experiment, count(*) AS epochs_run FROM h GROUP BY 1),
scored AS (SELECT experiment, max(macro_f1) AS f FROM sweep WHERE tau_ms = 400 GROUP BY 1)
SELECT substr(experiment, 1, 1) AS block, experiment, 'early' AS fusion, 'audio,' || experiment AS streams, 1000 * length(experiment) AS n_params, best_epoch, epochs_run, round(f, 9) AS macro_f1_at_train_tau FROM best JOIN ep USING (experiment) LEFT JOIN scored USING (experiment)""",
)
def run_experiments(spark, d):
    h = history(spark, d)
    block = F.substring("experiment", 1, 1).alias("block")
    epochs = h.groupBy("experiment").agg(F.count("*").alias("epochs_run"))
    runs = reports.best_epoch(h, "f1", ["experiment"]).join(epochs, "experiment").select(block, "experiment", F.lit("early").alias("fusion"), F.concat(F.lit("audio,"), "experiment").alias("streams"), (1000 * F.length("experiment")).cast("long").alias("n_params"), "best_epoch", "epochs_run")
    return rounded(metrics.run_experiments(sweep(spark, d).select(block, "*"), runs))
