"""Queries over the signal fixture: z-scores, lagged correlation, summaries, pooling, segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.scalars import lag_seconds
from parley.operators import dyads, filters, metrics, models, signals

from .fixtures import DUCKDB, ctes, fixture
from .q_metrics import r, rounded
from .registry import query

E = ctes(["e_pairs", "e_frames"], DUCKDB)
Z = E + """, st AS (SELECT window_id, feature, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM e_frames GROUP BY ALL),
z AS (SELECT window_id, frame, feature, (x - mx) / (sx + 1e-8) AS z_x, (y - my) / (sy + 1e-8) AS z_y FROM e_frames JOIN st USING (window_id, feature))"""
WCC = Z + """, lags AS (SELECT unnest(range(-10, 11)) AS lag),
wcc AS (SELECT a.window_id, 0 AS sub, a.feature, lag, avg(a.z_x * b.z_y) AS corr FROM z a, lags JOIN z b ON b.window_id = a.window_id AND b.feature = a.feature AND b.frame = a.frame - lag GROUP BY ALL)"""
PEARSON = E + """, lags AS (SELECT unnest(range(-10, 11)) AS lag),
wcc AS (SELECT a.window_id, 0 AS sub, a.feature, lag, CASE WHEN stddev_pop(a.x) < 1e-8 OR stddev_pop(b.y) < 1e-8 THEN 0e0 ELSE corr(a.x, b.y) END AS corr FROM e_frames a, lags JOIN e_frames b ON b.window_id = a.window_id AND b.feature = a.feature AND b.frame = a.frame - lag GROUP BY ALL)"""
PEAKS = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY window_id, sub, feature ORDER BY abs(corr) DESC, lag) AS k FROM wcc),
p AS (SELECT window_id, sub, feature, max(abs(corr)) FILTER (k = 1) AS peak, max(corr) FILTER (k = 1) AS signed, max(lag) FILTER (k = 1) AS best_lag, max(corr) FILTER (lag = 0) AS zero FROM ranked GROUP BY ALL)"""
LEAD = """avg(best_lag) AS mean_best_lag_frames, stddev_pop(best_lag) AS std_best_lag_frames, avg(abs(best_lag)) AS mean_abs_best_lag_frames, avg(best_lag) / 30e0 AS mean_best_lag_sec, avg(abs(best_lag)) / 30e0 AS mean_abs_best_lag_sec,
avg(CAST(best_lag > 0 AS DOUBLE)) AS listener_lead_ratio, avg(CAST(best_lag < 0 AS DOUBLE)) AS speaker_lead_ratio, avg(CAST(best_lag = 0 AS DOUBLE)) AS zero_lag_ratio"""
SUMMARY = PEARSON + PEAKS + f""", summary AS (SELECT window_id, avg(peak) AS mean_max_abs_corr, stddev_pop(peak) AS std_max_abs_corr, median(peak) AS median_max_abs_corr, max(peak) AS max_abs_corr, avg(signed) AS mean_signed_peak_corr, stddev_pop(signed) AS std_signed_peak_corr,
avg(zero) AS mean_zero_lag_corr, avg(abs(zero)) AS mean_abs_zero_lag_corr, stddev_pop(zero) AS std_zero_lag_corr, {LEAD},
avg(CAST(best_lag > 0 AS DOUBLE)) - avg(CAST(best_lag < 0 AS DOUBLE)) AS listener_speaker_lead_score, avg(CAST(peak > 0.5e0 AS DOUBLE)) AS high_sync_ratio FROM p GROUP BY window_id)"""
STATS = WCC + PEAKS + f""", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY abs(corr) DESC, lag, feature) AS k FROM wcc) WHERE k = 1),
prof AS (SELECT window_id, lag, avg(abs(corr)) AS a, avg(corr) AS s FROM wcc GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY a DESC, lag) AS k FROM prof) WHERE k = 1),
rest AS (SELECT window_id, avg(peak) AS mean_max_abs_corr, median(peak) AS median_max_abs_corr, stddev_pop(peak) AS std_max_abs_corr, avg(zero) AS mean_zero_lag_corr, avg(abs(zero)) AS mean_abs_zero_lag_corr, stddev_pop(zero) AS std_zero_lag_corr, {LEAD}, avg(CAST(peak >= 0.3e0 AS DOUBLE)) AS high_sync_ratio FROM p GROUP BY window_id),
stats AS (SELECT rest.*, abs(top.corr) AS global_peak_abs_corr, top.corr AS global_peak_signed_corr, CAST(top.lag AS INT) AS global_peak_lag_frames, top.lag / 30e0 AS global_peak_lag_sec, CAST(best.lag AS INT) AS best_mean_lag_frames, best.lag / 30e0 AS best_mean_lag_sec, best.a AS best_mean_abs_corr, best.s AS best_mean_signed_corr FROM rest JOIN top USING (window_id) JOIN best USING (window_id)),
win AS (SELECT stats.*, file_id, start_s, end_s, CAST(label AS INT) AS label FROM stats JOIN e_pairs USING (window_id))"""
SUMMARY_COLUMNS = ("mean_max_abs_corr", "std_max_abs_corr", "median_max_abs_corr", "max_abs_corr", "mean_signed_peak_corr", "std_signed_peak_corr", "mean_zero_lag_corr", "mean_abs_zero_lag_corr", "std_zero_lag_corr", "mean_best_lag_frames", "std_best_lag_frames", "mean_abs_best_lag_frames", "mean_best_lag_sec", "mean_abs_best_lag_sec", "listener_lead_ratio", "speaker_lead_ratio", "zero_lag_ratio", "listener_speaker_lead_score", "high_sync_ratio")


def frames(spark, d):
    return fixture(spark, d, "e_frames")


def stats(spark, d):
    """Window statistics with file, bounds and label."""
    s = signals.window_coordination_stats(signals.wcc_fast(frames(spark, d)))
    return s.join(fixture(spark, d, "e_pairs").select("window_id", "file_id", "start_s", "end_s", "label"), "window_id")


def r6(df):
    return rounded(df, 6)


@query("sliding_windows", "WITH w AS (SELECT vec_id AS file_id, unnest(range(0, 7)) AS i, embedding FROM embeddings) SELECT file_id, CAST(i AS INT) AS i, i * 0.5e0 AS start_s, i * 0.5e0 + 1e0 AS end_s, CAST(embedding[i * 8 + 1] AS DOUBLE) AS first, CAST(embedding[i * 8 + 16] AS DOUBLE) AS last FROM w")
def sliding_windows(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("file_id"), F.lit(16.0).alias("rate"), F.col("embedding").cast("array<double>").alias("samples"))
    w = signals.sliding_windows(e, 1.0, 0.5)
    return w.select("file_id", "i", "start_s", "end_s", F.get("samples", F.lit(0)).alias("first"), F.element_at("samples", -1).alias("last"))


@query("zscore_series", Z + f" SELECT window_id, frame, feature, {r('z_x', 'z_y', places=6)} FROM z")
def zscore_series(spark, d):
    return r6(signals.zscore_series(frames(spark, d), ["window_id", "feature"]).drop("x", "y"))


@query("wcc_fast", WCC + " SELECT window_id, feature, CAST(lag AS INT) AS lag, round(corr, 6) AS corr FROM wcc")
def wcc_fast(spark, d):
    return r6(signals.wcc_fast(frames(spark, d)))


@query("wcc_pearson", PEARSON + " SELECT window_id, sub, feature, CAST(lag AS INT) AS lag, round(corr, 6) AS corr FROM wcc")
def wcc_pearson(spark, d):
    return r6(signals.wcc_pearson(frames(spark, d)))


@query("wcc_summary", SUMMARY + f" SELECT window_id, {r(*SUMMARY_COLUMNS, places=6)} FROM summary")
def wcc_summary(spark, d):
    return r6(signals.wcc_summary(signals.wcc_pearson(frames(spark, d))))


_STAT_COLUMNS = ("global_peak_abs_corr", "global_peak_signed_corr", "global_peak_lag_sec", "best_mean_lag_sec", "best_mean_abs_corr", "best_mean_signed_corr", "mean_max_abs_corr", "median_max_abs_corr", "std_max_abs_corr", "mean_zero_lag_corr", "mean_abs_zero_lag_corr", "std_zero_lag_corr", "mean_best_lag_frames", "std_best_lag_frames", "mean_abs_best_lag_frames", "mean_best_lag_sec", "mean_abs_best_lag_sec", "listener_lead_ratio", "speaker_lead_ratio", "zero_lag_ratio", "high_sync_ratio")


@query("window_coordination_stats", STATS + f" SELECT window_id, global_peak_lag_frames, best_mean_lag_frames, {r(*_STAT_COLUMNS, places=6)} FROM stats")
def window_coordination_stats(spark, d):
    return r6(signals.window_coordination_stats(signals.wcc_fast(frames(spark, d))))


@query("mean_pool", E + " SELECT window_id, feature, frame // 5 AS frame, round(avg(x), 6) AS x FROM e_frames WHERE frame < 30 GROUP BY ALL")
def mean_pool(spark, d):
    return r6(signals.mean_pool(frames(spark, d), 100.0, 20.0))


@query("fix_seq_len", "SELECT vec_id, greatest(0, 5 - (1 + vec_id % 8)) AS padded, least(5, 1 + vec_id % 8) AS kept, round(list_sum(list_transform(embedding[1:CAST(2 * least(5, 1 + vec_id % 8) AS INT)], lambda v: CAST(v AS DOUBLE))), 6) AS total FROM embeddings")
def fix_seq_len(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("n", F.col("vec_id") % 8 + 1)
    v = F.col("embedding").cast("array<double>")
    m = F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), lambda i: F.slice(v, i * 2 + 1, 2))
    fixed = e.select("vec_id", "n", signals.fix_seq_len(m, 5, 2).alias("m"))
    # rows beyond n are zero by construction; any other row of a random vector is not
    zero = F.size(F.filter("m", lambda x: (x[0] == 0.0) & (x[1] == 0.0))).cast("long")
    return r6(fixed.select("vec_id", zero.alias("padded"), (F.size("m") - zero).alias("kept"), F.aggregate(F.flatten("m"), F.lit(0.0), lambda t, x: t + x).alias("total")))


@query("orient_lag_matrix", WCC + " SELECT window_id, lag, round(max(corr) FILTER (feature = 0), 6) AS f0, round(max(corr) FILTER (feature = 1), 6) AS f1 FROM (SELECT window_id, CAST(lag + 10 AS INT) AS lag, feature, corr FROM wcc) GROUP BY ALL")
def orient_lag_matrix(spark, d):
    w = signals.wcc_fast(frames(spark, d))
    per_feature = w.groupBy("window_id", "feature").agg(F.array_sort(F.collect_list(F.struct("lag", "corr"))).alias("s")).select("window_id", "feature", F.transform("s", lambda x: x["corr"]).alias("row"))
    m = per_feature.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("feature", "row"))).alias("f")).select("window_id", F.transform("f", lambda x: x["row"]).alias("m"))
    rows = m.select("window_id", F.posexplode(signals.orient_lag_matrix(F.col("m"))).alias("lag", "v"))
    return r6(rows.select("window_id", "lag", F.col("v")[0].alias("f0"), F.col("v")[1].alias("f1")))


@query("lag_seconds", WCC + PEAKS + " SELECT window_id, feature, round(best_lag / 30e0, 9) AS best_lag_s FROM p")
def lag_seconds_query(spark, d):
    p = signals._peaks(signals.wcc_fast(frames(spark, d)), ["window_id", "feature"])
    return p.select("window_id", "feature", F.round(lag_seconds("best_lag"), 9).alias("best_lag_s"))


@query("label_segments", STATS + """, marked AS (SELECT *, CASE WHEN label = lag(label) OVER w AND start_s = lag(end_s) OVER w THEN 0 ELSE 1 END AS fresh FROM win WINDOW w AS (PARTITION BY file_id ORDER BY start_s, end_s, window_id)),
seg AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY file_id ORDER BY start_s, end_s, window_id) AS BIGINT) AS segment_id FROM marked)
SELECT file_id, segment_id, label, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_windows, max(end_s) - min(start_s) AS duration_s, round(avg(mean_max_abs_corr), 6) AS mean_peak_corr FROM seg GROUP BY ALL""")
def label_segments(spark, d):
    s = signals.label_segments(stats(spark, d))
    return r6(s.select("file_id", "segment_id", "label", "start_s", "end_s", "n_windows", "duration_s", "mean_peak_corr"))


@query("label_segments_all", STATS + """, marked AS (SELECT *, CASE WHEN label = lag(label) OVER w AND start_s = lag(end_s) OVER w THEN 0 ELSE 1 END AS fresh FROM win WINDOW w AS (ORDER BY start_s, end_s, window_id)),
seg AS (SELECT *, CAST(sum(fresh) OVER (ORDER BY start_s, end_s, window_id) AS BIGINT) AS segment_id FROM marked)
SELECT segment_id, label, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_windows, max(end_s) - min(start_s) AS duration_s, round(avg(mean_max_abs_corr), 6) AS mean_peak_corr FROM seg GROUP BY ALL""")
def label_segments_all(spark, d):
    s = signals.label_segments(stats(spark, d), ())
    return r6(s.select("segment_id", "label", "start_s", "end_s", "n_windows", "duration_s", "mean_peak_corr"))


_SUBS = E + """, lags AS (SELECT unnest(range(-10, 11)) AS lag), subs AS (SELECT unnest(range(0, 4)) AS sub),
wcc AS (SELECT a.window_id, sub, a.feature, lag, CASE WHEN stddev_pop(a.x) < 1e-8 OR stddev_pop(b.y) < 1e-8 THEN 0e0 ELSE corr(a.x, b.y) END AS corr FROM e_frames a, lags, subs JOIN e_frames b ON b.window_id = a.window_id AND b.feature = a.feature AND b.frame = a.frame - lag
  WHERE a.frame BETWEEN sub * 4 AND sub * 4 + 19 AND b.frame BETWEEN sub * 4 AND sub * 4 + 19 GROUP BY ALL)"""


@query("wcc_pearson_overlapping", _SUBS + " SELECT window_id, CAST(sub AS INT) AS sub, feature, CAST(lag AS INT) AS lag, round(corr, 6) AS corr FROM wcc")
def wcc_pearson_overlapping(spark, d):
    return r6(signals.wcc_pearson(frames(spark, d), win=20, stride=4))


@query("coordination_by_label", SUMMARY + " SELECT CAST(e.label AS INT) AS label, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in SUMMARY_COLUMNS) + " FROM summary JOIN e_pairs e USING (window_id) GROUP BY 1")
def coordination_by_label(spark, d):
    s = signals.wcc_summary(signals.wcc_pearson(frames(spark, d))).join(fixture(spark, d, "e_pairs").select("window_id", "label"), "window_id")
    return r6(metrics.coordination_by_label(s, list(SUMMARY_COLUMNS)))


_FUNCTION = {"avg": "avg", "stddev_samp": "stddev_samp", "median": "median"}


@query("coordination_label_summary", STATS + " SELECT label, count(*) AS n_windows, 2e0 * count(*) AS total_duration_s, " + ", ".join(f"round({_FUNCTION[f]}({c}), 6) AS {o}" for o, c, f in metrics._LABEL_SUMMARY) + " FROM win GROUP BY label")
def coordination_label_summary(spark, d):
    return r6(metrics.coordination_label_summary(stats(spark, d)))


@query("coordination_video_label", STATS + " SELECT file_id, label, count(*) AS n_windows, " + ", ".join(f"round({_FUNCTION[f]}({c}), 6) AS {o}" for o, c, f in metrics._LABEL_SUMMARY if o in metrics._VIDEO_LABEL) + " FROM win GROUP BY file_id, label")
def coordination_video_label(spark, d):
    return r6(metrics.coordination_video_label(stats(spark, d)))


@query("attach_coordination", SUMMARY + " SELECT e.window_id, round(coalesce(s.max_abs_corr, 0e0), 6) AS max_abs_corr, round(coalesce(s.high_sync_ratio, 0e0), 6) AS high_sync_ratio FROM e_pairs e LEFT JOIN (SELECT * FROM summary WHERE window_id % 7 <> 0) s USING (window_id)")
def attach_coordination(spark, d):
    s = signals.wcc_summary(signals.wcc_pearson(frames(spark, d))).where("window_id % 7 <> 0")
    return r6(dyads.attach_coordination(fixture(spark, d, "e_pairs").select("window_id"), s, ["max_abs_corr", "high_sync_ratio"], ["window_id"]))


@query("attach_continuous_coordination", E + " SELECT window_id, CASE WHEN window_id % 2 = 0 THEN 32 WHEN window_id % 3 = 0 THEN 16 ELSE 1 END AS n_rows, CASE WHEN window_id % 2 = 0 OR window_id % 3 = 0 THEN round(CAST(sx[1] AS DOUBLE), 6) ELSE 0e0 END AS first FROM e_pairs")
def attach_continuous_coordination(spark, d):
    p = fixture(spark, d, "e_pairs")
    v = F.col("sx").cast("array<double>")
    rows = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(v, i * 2 + 1, 2))
    layouts = [p.where("window_id % 2 = 0").select("window_id", rows(32).alias("matrix")), p.where("window_id % 3 = 0").select("window_id", rows(16).alias("matrix"))]
    a = dyads.attach_continuous(p.select("window_id"), layouts, ["window_id"], 2)
    return r6(a.select("window_id", F.size("matrix").alias("n_rows"), F.col("matrix")[0][0].alias("first")))


@query("finite_check", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS n_nan, CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END AS n_inf, vec_id % 5 <> 0 AND vec_id % 7 <> 0 AS ok FROM embeddings")
def finite_check(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    one = lambda cond, v: F.when(cond, F.array(F.lit(v))).otherwise(F.expr("cast(array() as array<double>)"))
    a = F.concat(F.col("embedding").cast("array<double>"), one(F.col("vec_id") % 5 == 0, float("nan")), one(F.col("vec_id") % 7 == 0, float("inf")))
    return e.select("vec_id", filters.finite_counts(a).alias("c")).select("vec_id", "c.*")


def _long(spark, d):
    f = frames(spark, d)
    side = lambda s, c: f.select("window_id", F.lit(s).alias("stream"), "frame", "feature", F.col(c).alias("value"))
    return side("speaker", "x").unionByName(side("listener", "y"))


@query("pool_features", E + ", m AS (SELECT window_id, feature, avg(x) AS ax, avg(y) AS ay FROM e_frames GROUP BY ALL) SELECT window_id, " + ", ".join(f"round(max({c}) FILTER (feature = {k}), 6) AS f{i}" for i, (c, k) in enumerate((("ax", 0), ("ax", 1), ("ay", 0), ("ay", 1)))) + " FROM m GROUP BY window_id")
def pool_features(spark, d):
    p = models.pool_features(_long(spark, d), ("speaker", "listener"))
    return r6(p.select("window_id", *[F.col("features")[i].alias(f"f{i}") for i in range(4)]))


@query("assemble_streams", E + " SELECT window_id, round(CAST(sx[1] AS DOUBLE), 6) AS speaker_first, round(CAST(lx[1] AS DOUBLE), 6) AS listener_first FROM e_pairs WHERE window_id % 6 <> 0")
def assemble_streams(spark, d):
    p = fixture(spark, d, "e_pairs")
    samples = p.select(F.col("window_id").alias("sample_key"), "window_id", F.lit("s").alias("speaker_file_id"), F.lit("l").alias("listener_file_id"))
    streams = spark.createDataFrame([(0, "face", "speaker"), (1, "face", "listener")], "stream_idx int, modality string, role string")
    features = p.select(F.lit("face").alias("modality"), F.lit("s").alias("file_id"), "window_id", F.col("sx").cast("array<double>").alias("values")).unionByName(p.where("window_id % 6 <> 0").select(F.lit("face").alias("modality"), F.lit("l").alias("file_id"), "window_id", F.col("lx").cast("array<double>").alias("values")))
    a = signals.assemble_streams(samples, streams, features)
    return r6(a.select(F.col("sample_key").alias("window_id"), F.col("streams")[0][0].alias("speaker_first"), F.col("streams")[1][0].alias("listener_first")))
