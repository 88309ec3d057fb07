"""Queries over the conversation fixture: ids, filters, joins, labelling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import scalars as S
from parley.operators import dyads, filters, intervals, labelling, metrics, timeindex
from parley.operators.graphs import shared_folder, written
from parley.sources import sinks

from .fixtures import DUCKDB, TAUS, ctes, fixture
from .label_sql import LEXICON, NORMAL, with_labels, with_samples, with_utterances
from .registry import query


def V(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fixture(spark, d, "v_manifest"), fixture(spark, d, "v_intervals"), fixture(spark, d, "v_words")


def labels(spark: SparkSession, d: str, taus: tuple[int, ...] = TAUS) -> DataFrame:
    m, i, w = V(spark, d)
    return labelling.label_windows(m, i, w, taus, max_tau_ms=max(TAUS))


def samples(spark: SparkSession, d: str) -> DataFrame:
    m, i, _ = V(spark, d)
    return labelling.sample_grid(m, i)


@query("label_windows", with_labels() + " SELECT * FROM labels")
def label_windows(spark, d):
    return labels(spark, d)


@query("sample_grid", with_samples() + " SELECT file_id, other_file_id, split, CAST(i AS INT) AS i, t FROM samples")
def sample_grid(spark, d):
    return samples(spark, d).select("file_id", "other_file_id", "split", "i", "t")


@query("label_counts", with_labels() + " SELECT tau_ms, split, count(*) AS n_samples, " + ", ".join(f"count(*) FILTER (label = {c}) AS n_{c}" for c in range(6)) + " FROM labels GROUP BY tau_ms, split")
def label_counts(spark, d):
    return labelling.label_counts(labels(spark, d))


@query(
    "dyad_summary",
    with_labels() + " SELECT m.interaction_id, coalesce(n, 0) AS n_samples, file_id_a IN (SELECT file_id FROM v_words) AS transcript_a, file_id_b IN (SELECT file_id FROM v_words) AS transcript_b, duration_s FROM v_manifest m LEFT JOIN (SELECT interaction_id, count(DISTINCT sample_key) AS n FROM labels GROUP BY 1) USING (interaction_id)",
)
def dyad_summary(spark, d):
    m, i, w = V(spark, d)
    return labelling.dyad_summary(m, labelling.label_windows(m, i, w), w)


@query("substantive_utterance", with_utterances() + " SELECT file_id, CAST(i AS INT) AS i, tau_ms, seg_idx, dur >= 700e0 OR n >= 3 OR o > 0 AS substantive FROM uw")
def substantive_utterance(spark, d):
    u = _utterances(spark, d)
    return u.select("file_id", "i", "tau_ms", F.col("iv_seg_idx").alias("seg_idx"), labelling.is_substantive(F.col("duration_ms"), F.col("n_words"), F.col("n_other"), labelling.Thresholds()).alias("substantive"))


@query("backchannel_qualifying", with_utterances() + " SELECT file_id, CAST(i AS INT) AS i, tau_ms, seg_idx, dur <= 500e0 AND (n <= 2 OR o = 0) AS qualifies FROM uw")
def backchannel_qualifying(spark, d):
    u = _utterances(spark, d)
    return u.select("file_id", "i", "tau_ms", F.col("iv_seg_idx").alias("seg_idx"), labelling.is_backchannel(F.col("duration_ms"), F.col("n_words"), F.col("n_other"), labelling.Thresholds()).alias("qualifies"))


def _utterances(spark, d):
    _, i, w = V(spark, d)
    return labelling.utterance_stats(samples(spark, d), i, w).where("is_part")


@query("classify_horizon", with_labels() + " SELECT tau_ms, label, count(*) AS n FROM labels GROUP BY tau_ms, label")
def classify_horizon(spark, d):
    m, i, w = V(spark, d)
    return labelling.label_samples(labelling.sample_grid(m, i), i, w).groupBy("tau_ms", "label").agg(F.count("*").alias("n"))


# --- joins of points and intervals ---------------------------------------------------------


@query("voiced_at", with_samples() + " SELECT g.file_id, CAST(g.i AS INT) AS i, EXISTS (SELECT 1 FROM v_intervals v WHERE v.file_id = g.other_file_id AND g.t BETWEEN v.start_s AND v.end_s) AS voiced FROM samples g")
def voiced_at(spark, d):
    s, i = samples(spark, d), fixture(spark, d, "v_intervals")
    yes = intervals.voiced_at(s, i, "other_file_id", "t").select("file_id", "i", F.lit(True).alias("v"))
    return s.join(yes, ["file_id", "i"], "left").select("file_id", "i", F.coalesce("v", F.lit(False)).alias("voiced"))


@query("current_turn_end", with_samples() + " SELECT file_id, CAST(i AS INT) AS i, a_end AS turn_end FROM samples")
def current_turn_end(spark, d):
    return intervals.current_turn_end(samples(spark, d), fixture(spark, d, "v_intervals"), "file_id", "t", ["file_id", "i"])


@query("utterances_in_horizon", with_utterances() + " SELECT file_id, CAST(i AS INT) AS i, seg_idx, c_start, c_end FROM u WHERE tau_ms = 800")
def utterances_in_horizon(spark, d):
    u = intervals.utterances_in_horizon(samples(spark, d), fixture(spark, d, "v_intervals"), "other_file_id", "t", F.lit(0.8))
    return u.select("file_id", "i", F.col("iv_seg_idx").alias("seg_idx"), "c_start", "c_end")


@query("words_in_utterance", with_utterances() + " SELECT file_id, CAST(i AS INT) AS i, seg_idx, CAST(n AS BIGINT) AS n_words FROM uw WHERE tau_ms = 800")
def words_in_utterance(spark, d):
    u = intervals.utterances_in_horizon(samples(spark, d), fixture(spark, d, "v_intervals"), "other_file_id", "t", F.lit(0.8))
    w = intervals.words_in_utterance(u.select("file_id", "i", "other_file_id", "iv_seg_idx", "c_start", "c_end"), fixture(spark, d, "v_words"), "other_file_id")
    return w.groupBy("file_id", "i", F.col("iv_seg_idx").alias("seg_idx")).agg(F.count("w_start_s").alias("n_words"))


@query("clip_interval", with_samples() + " SELECT file_id, CAST(i AS INT) AS i, v.seg_idx, CASE WHEN greatest(v.start_s, t) < least(v.end_s, t + 0.4e0) THEN greatest(v.start_s, t) END AS c_start, CASE WHEN greatest(v.start_s, t) < least(v.end_s, t + 0.4e0) THEN least(v.end_s, t + 0.4e0) END AS c_end FROM samples JOIN v_intervals v USING (file_id) WHERE v.start_s <= t + 0.4e0 AND v.end_s >= t")
def clip_interval(spark, d):
    s = samples(spark, d).withColumn("h", F.col("t") + 0.4)
    o = intervals.overlapping(s, fixture(spark, d, "v_intervals"), "file_id", "t", "h")
    c = S.clip_interval("iv_start_s", "iv_end_s", "t", F.lit(0.4))
    return o.select("file_id", "i", F.col("iv_seg_idx").alias("seg_idx"), c["start"].alias("c_start"), c["end"].alias("c_end"))


# --- the same joins on the stored index ------------------------------------------------------


@query("indexed_joins", with_utterances() + """, g AS (SELECT s.file_id, CAST(s.i AS INT) AS i, EXISTS (SELECT 1 FROM v_intervals v WHERE v.file_id = s.other_file_id AND s.t BETWEEN v.start_s AND v.end_s) AS other_voiced, a_end AS turn_end FROM samples s)
SELECT g.file_id, g.i, other_voiced, turn_end, seg_idx, CAST(n AS BIGINT) AS n_words, CAST(o AS BIGINT) AS n_other FROM g LEFT JOIN (SELECT * FROM uw WHERE tau_ms = 800) u ON u.file_id = g.file_id AND u.i = g.i""")
def indexed_joins(spark, d):
    """Voiced points, turn ends, utterances and their words, each a join with one stored index."""
    _, i, w = V(spark, d)
    index = timeindex.stored(timeindex.time_index(i, w, 0.8))
    s = samples(spark, d).select("file_id", "other_file_id", "i", "t")
    yes = timeindex.voiced_points(s, index, "other_file_id", "t").select("file_id", "i", F.lit(True).alias("v"))
    u = timeindex.utterances_ahead(s, index, "other_file_id", "t", 0.8, with_words=True).select("file_id", "i", F.col("iv_seg_idx").alias("seg_idx"), "n_words", "n_other")
    base = timeindex.point_turn_ends(s, index, "file_id", "t").join(yes, ["file_id", "i"], "left")
    return base.join(u, ["file_id", "i"], "left").select("file_id", "i", F.coalesce("v", F.lit(False)).alias("other_voiced"), "turn_end", "seg_idx", "n_words", "n_other")


# --- scalars ---------------------------------------------------------------------------------

_F = ctes(["v_files"], DUCKDB)


@query("parse_ids", _F + " SELECT file_id, regexp_extract(file_id, '^(.*)_([^_]*)$', 1) AS interaction_id, regexp_extract(file_id, '^(.*)_([^_]*)$', 2) AS participant_id FROM v_files")
def parse_ids(spark, d):
    f = fixture(spark, d, "v_files").select("file_id")
    return f.select("file_id", S.interaction_id("file_id").alias("interaction_id"), S.participant_id("file_id").alias("participant_id"))


@query("parse_prompt_vendor_session", _F + " SELECT interaction_id, regexp_extract(interaction_id, 'I([0-9]+)', 1) AS prompt_hash, split_part(interaction_id, '_', 1) AS vendor, substr(split_part(interaction_id, '_', 2), 2) AS session FROM v_files")
def parse_prompt_vendor_session(spark, d):
    f = fixture(spark, d, "v_files")
    return f.select("interaction_id", S.prompt_hash("interaction_id").alias("prompt_hash"), S.vendor("interaction_id").alias("vendor"), S.session("interaction_id").alias("session"))


@query("asset_urls", _F + f" SELECT file_id, '{S.ASSET_BASE}/naturalistic/' || split || '/audio/' || file_id || '.wav' AS audio_url, '{S.ASSET_BASE}/naturalistic/' || split || '/vad/' || file_id || '.jsonl' AS vad_url FROM v_files")
def asset_urls(spark, d):
    f = fixture(spark, d, "v_files")
    return f.select("file_id", S.asset_url(F.lit("naturalistic"), "split", "audio", "file_id", "wav").alias("audio_url"), S.asset_url(F.lit("naturalistic"), "split", "vad", "file_id", "jsonl").alias("vad_url"))


@query("sample_key", ctes(["v_words"], DUCKDB) + " SELECT file_id, start_s, printf('%s_t_%07d', file_id, CAST(round_even(start_s * 1e3, 0) AS BIGINT)) AS sample_key FROM v_words")
def sample_key(spark, d):
    w = fixture(spark, d, "v_words")
    return w.select("file_id", "start_s", S.sample_key("file_id", "start_s").alias("sample_key"))


@query("parse_sample_key", with_samples() + ", k AS (SELECT printf('%s_t_%07d', file_id, CAST(t * 1e3 AS BIGINT)) AS sample_key FROM samples) SELECT sample_key, regexp_extract(sample_key, '^(.*)_t_([0-9]+)$', 1) AS file_id, round(CAST(regexp_extract(sample_key, '_t_([0-9]+)$', 1) AS BIGINT) / 1e3 - 2e0, 3) AS start_s, CAST(regexp_extract(sample_key, '_t_([0-9]+)$', 1) AS BIGINT) / 1e3 AS end_s FROM k")
def parse_sample_key(spark, d):
    k = samples(spark, d).select(S.sample_key("file_id", "t").alias("sample_key"))
    return k.select("sample_key", S.key_file_id("sample_key").alias("file_id"), S.key_start_s("sample_key").alias("start_s"), S.key_end_s("sample_key").alias("end_s"))


@query("window_name", with_samples() + " SELECT file_id, t, printf('%07.2f-%07.2f_%s', t - 2e0, t, file_id) AS name, t - 2e0 AS back_start, t AS back_end FROM samples")
def window_name(spark, d):
    s = samples(spark, d).select("file_id", "t", S.window_name(F.col("t") - 2.0, "t", "file_id").alias("name"))
    back = S.parse_window_name("name")
    return s.select("file_id", "t", "name", back["start"].alias("back_start"), back["end"].alias("back_end"))


@query("clean_file_id", _F + " SELECT file_id AS clean, count(*) AS n FROM v_files GROUP BY 1")
def clean_file_id(spark, d):
    f = fixture(spark, d, "v_files").select(F.concat("file_id", F.element_at(F.array(F.lit(".mp4"), F.lit(".npy"), F.lit(".wav")), (F.col("conv_id") % 3 + 1).cast("int"))).alias("raw"))
    return f.groupBy(S.clean_file_id("raw").alias("clean")).agg(F.count("*").alias("n"))


@query("normalize_word", ctes(["v_words"], DUCKDB) + f" SELECT word, {NORMAL} AS norm, {NORMAL} IN ({LEXICON}) AS is_backchannel, count(*) AS n FROM v_words GROUP BY ALL")
def normalize_word(spark, d):
    w = fixture(spark, d, "v_words").groupBy("word").agg(F.count("*").alias("n"))
    return w.select("word", S.normalize_word("word").alias("norm"), S.is_backchannel_token("word").alias("is_backchannel"), "n")


@query("is_bc_token", ctes(["v_words"], DUCKDB) + f" SELECT file_id, count(*) FILTER ({NORMAL} IN ({LEXICON})) AS n_backchannel, count(*) AS n FROM v_words GROUP BY file_id")
def is_bc_token(spark, d):
    w = fixture(spark, d, "v_words")
    return w.groupBy("file_id").agg(F.count_if(S.is_backchannel_token("word")).alias("n_backchannel"), F.count("*").alias("n"))


@query("fmt_clock", ctes(["v_intervals"], DUCKDB) + """ SELECT file_id, seg_idx, printf('%d:%02d.%d', ms // 60000, tenths // 10, tenths % 10) AS clock FROM (
  SELECT *, ms % 60000 // 100 + CASE WHEN ms % 100 > 50 OR (ms % 100 = 50 AND ms % 60000 // 100 % 2 = 1) THEN 1 ELSE 0 END AS tenths FROM (SELECT *, CAST(round(start_s * 1000) AS BIGINT) AS ms FROM v_intervals) c0) c1""")
def fmt_clock(spark, d):
    return fixture(spark, d, "v_intervals").select("file_id", "seg_idx", S.fmt_clock("start_s").alias("clock"))


@query("class_name", with_labels() + " SELECT CASE label " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.CLASS_NAMES.items()) + " END AS name, count(*) AS n FROM labels GROUP BY 1")
def class_name(spark, d):
    return labels(spark, d).groupBy(S.class_name("label").alias("name")).agg(F.count("*").alias("n"))


@query("try_float", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'none' WHEN event_id % 3 = 1 THEN '' ELSE CAST(user_id AS VARCHAR) || '.5' END AS DOUBLE) AS x FROM events")
def try_float(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    raw = F.when(F.col("event_id") % 3 == 0, "none").when(F.col("event_id") % 3 == 1, "").otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".5")))
    return e.select("event_id", S.try_float(raw).alias("x"))


@query("window_mid", ctes(["v_intervals"], DUCKDB) + " SELECT file_id, seg_idx, (start_s + end_s) / 2e0 AS mid FROM v_intervals")
def window_mid(spark, d):
    return fixture(spark, d, "v_intervals").select("file_id", "seg_idx", S.window_mid("start_s", "end_s").alias("mid"))


@query("resolve_column", "SELECT c_custkey AS id FROM customer")
def resolve_column(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col(S.resolve_column(c, ["customer_id", "C_CustKey"])).alias("id"))


# --- filters -----------------------------------------------------------------------------------


@query("training_class_filter", with_labels() + " SELECT sample_key, tau_ms, label FROM labels WHERE label IN (0, 1, 2)")
def training_class_filter(spark, d):
    return filters.training_class_filter(labels(spark, d)).select("sample_key", "tau_ms", "label")


@query("split_filter", with_labels() + " SELECT sample_key, tau_ms, label FROM labels WHERE split = 'val'")
def split_filter(spark, d):
    path = f"{shared_folder(spark).rstrip('/')}/label-store-{uuid.uuid4().hex}"
    sinks.write_label_store(labels(spark, d), path)
    return filters.split_filter(sinks.read_label_store(spark, path, ["sample_key", "split", "tau_ms", "label"]), "val").select("sample_key", "tau_ms", "label")


@query("exclude_ids", ctes(["v_manifest"], DUCKDB) + " SELECT interaction_id, split FROM v_manifest WHERE conv_id % 9 <> 4")
def exclude_ids(spark, d):
    m = fixture(spark, d, "v_manifest")
    return filters.exclude_ids(m, m.where("conv_id % 9 = 4"), "interaction_id").select("interaction_id", "split")


@query("domain_filter", ctes(["v_manifest"], DUCKDB) + " SELECT interaction_id, CASE WHEN split NOT IN ('train', 'val') THEN 'bad_split' WHEN relationship <> 'stranger' THEN 'bad_relationship' ELSE 'ok' END AS verdict FROM v_manifest")
def domain_filter(spark, d):
    kept, rejects = filters.domain_filter(fixture(spark, d, "v_manifest"), {"split": ["train", "val"], "relationship": ["stranger"]})
    return kept.select("interaction_id", F.lit("ok").alias("verdict")).unionByName(rejects.select("interaction_id", F.col("reason").alias("verdict")))


@query("both_annotated", _F + " SELECT interaction_id, min(file_id) AS file_id_a, max(file_id) AS file_id_b FROM v_files WHERE conv_id % 3 <> 0 OR file_id LIKE '%P0001' GROUP BY 1 HAVING count(*) = 2")
def both_annotated(spark, d):
    f = fixture(spark, d, "v_files").select("interaction_id", "file_id", F.lit("naturalistic").alias("label"), F.when((F.col("conv_id") % 3 != 0) | F.col("file_id").endswith("P0001"), "1").otherwise("0").alias("has_annotation_3p"))
    return filters.both_annotated(f)


def _streams(spark):
    return spark.createDataFrame([("x1", 0, "audio", "speaker", False), ("x1", 1, "audio", "listener", False), ("x1", 2, "wcc", "speaker", True)], "experiment string, stream_idx int, modality string, role string, exempt boolean")


def _role_samples(spark, d):
    return dyads.enumerate_samples(fixture(spark, d, "v_manifest"), labels(spark, d, (400,)))


_ROLE = with_labels("t_assets") + ", rs AS (SELECT sample_key, l.label, l.interaction_id, l.file_id AS speaker_file_id, p.other_file_id AS listener_file_id, l.split, t_ms / 1e3 - 2e0 AS start_s, t_ms / 1e3 AS end_s FROM labels l JOIN persp p ON p.file_id = l.file_id WHERE tau_ms = 400 AND label IN (0, 1, 2))"


@query("complete_samples", _ROLE + " SELECT sample_key, concat_ws(',', CASE WHEN listener_file_id NOT IN (SELECT file_id FROM t_assets) THEN 'listener:audio' END, CASE WHEN speaker_file_id NOT IN (SELECT file_id FROM t_assets) THEN 'speaker:audio' END) AS missing FROM rs")
def complete_samples(spark, d):
    index = fixture(spark, d, "t_assets").select(F.lit("audio").alias("modality"), "file_id")
    rows = _role_samples(spark, d).select("sample_key", "speaker_file_id", "listener_file_id")
    kept, dropped = filters.complete_samples(rows, _streams(spark), index)
    return kept.select("sample_key", F.lit("").alias("missing")).unionByName(dropped.select("sample_key", "missing"))


@query("resume_skip", ctes(["v_files", "t_assets"], DUCKDB) + " SELECT file_id FROM v_files WHERE file_id NOT IN (SELECT file_id FROM t_assets WHERE bytes > 0)")
def resume_skip(spark, d):
    return filters.resume_skip(fixture(spark, d, "v_files"), fixture(spark, d, "t_assets"), "file_id").select("file_id")


@query(
    "resume_plan",
    ctes(["v_manifest", "v_words", "v_files"], DUCKDB) + """, said AS (SELECT DISTINCT file_id FROM v_words), t AS (SELECT f.file_id, conv_id % 5 AS k FROM v_files f JOIN said USING (file_id))
SELECT file_id, CASE k WHEN 0 THEN 'no_sidecar' WHEN 1 THEN 'empty_output' WHEN 2 THEN 'changed_parameter' WHEN 3 THEN 'changed_input' ELSE 'done' END AS reason FROM t""",
)
def resume_plan(spark, d):
    """Sidecars as an earlier run would have left them: none, of an empty output, of other parameters, of other words, and good ones."""
    f = fixture(spark, d, "v_files").select("file_id", (F.col("conv_id") % 5).alias("k"))
    w = fixture(spark, d, "v_words").select("file_id", "word", "start_s")
    path = f"{shared_folder(spark).rstrip('/')}/resume-{uuid.uuid4().hex}"
    keyed = w.join(f, "file_id")
    earlier = keyed.where("k <> 0").withColumn("word", F.when(F.col("k") == 3, F.concat("word", F.lit("x"))).otherwise(F.col("word")))
    old = filters.fingerprints(earlier.where("k <> 2").drop("k"), "file_id", {"stride": "500"}).unionByName(filters.fingerprints(earlier.where("k = 2").drop("k"), "file_id", {"stride": "250"}))
    sinks.write_with_sidecars(earlier.where("k <> 1").groupBy("file_id").agg(F.count("*").alias("n")), old, path, "file_id")
    now = filters.fingerprints(w, "file_id", {"stride": "500"})
    return filters.resume_plan(now, sinks.read_sidecars(spark, path, "file_id"), "file_id").select("file_id", "reason")


@query("dominant_length", ctes(["t_assets"], DUCKDB) + ", n AS (SELECT conv_id % 4 AS grp, t, count(*) AS c FROM t_assets GROUP BY ALL), b AS (SELECT grp, t FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY c DESC, t DESC) AS r FROM n) WHERE r = 1) SELECT file_id, a.t = b.t AS kept FROM t_assets a JOIN b ON b.grp = a.conv_id % 4")
def dominant_length(spark, d):
    kept, rejects = filters.dominant_length(fixture(spark, d, "t_assets").withColumn("grp", F.col("conv_id") % 4), "grp", "t")
    return kept.select("file_id", F.lit(True).alias("kept")).unionByName(rejects.select("file_id", F.lit(False).alias("kept")))


@query("missing_key_report", with_labels() + " SELECT CASE WHEN label NOT IN (0, 1, 2) THEN 'non_training' WHEN split = 'test' THEN 'not_in_manifest' ELSE 'usable' END AS tag, count(*) AS n FROM labels GROUP BY 1")
def missing_key_report(spark, d):
    return filters.missing_key_report(labels(spark, d), fixture(spark, d, "v_manifest").where("split <> 'test'"))


# --- dyads -------------------------------------------------------------------------------------


@query("speaker_listener_lookup", ctes(["v_manifest"], DUCKDB) + " SELECT interaction_id, file_id_a AS file_id, file_id_b AS other_file_id, 'a' AS role FROM v_manifest UNION ALL SELECT interaction_id, file_id_b, file_id_a, 'b' FROM v_manifest")
def speaker_listener_lookup(spark, d):
    return dyads.perspectives(fixture(spark, d, "v_manifest"), ["interaction_id"])


@query("enumerate_samples", _ROLE + " SELECT * FROM rs")
def enumerate_samples(spark, d):
    return _role_samples(spark, d).drop("tau_ms")


@query("match_speaker_listener_windows", _ROLE + " SELECT sample_key, 'p/' || speaker_file_id AS speaker_path, 'p/' || listener_file_id AS listener_path FROM rs WHERE speaker_file_id IN (SELECT file_id FROM t_assets) AND listener_file_id IN (SELECT file_id FROM t_assets)")
def match_speaker_listener_windows(spark, d):
    s = written(_role_samples(spark, d))
    ms = lambda c: F.rint(F.col(c) * 1000).cast("long")
    windows = s.select(F.explode(F.array("speaker_file_id", "listener_file_id")).alias("file_id"), ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms")).distinct()
    index = windows.join(fixture(spark, d, "t_assets").select("file_id"), "file_id", "left_semi").withColumn("path", F.concat(F.lit("p/"), "file_id"))
    return dyads.match_windows(s, index)[0].select("sample_key", "speaker_path", "listener_path")


@query("label_lookup", with_labels() + ", l4 AS (SELECT sample_key, label FROM labels WHERE tau_ms = 400 AND split = 'train') SELECT DISTINCT k.sample_key, l4.label FROM (SELECT DISTINCT sample_key FROM labels) k LEFT JOIN l4 USING (sample_key)")
def label_lookup(spark, d):
    l = labels(spark, d)
    return dyads.label_lookup(l.select("sample_key").distinct(), l.where("tau_ms = 400 AND split = 'train'"))


@query("samples_x_tau", with_samples() + f" SELECT file_id, CAST(i AS INT) AS i, tau_ms FROM samples, (SELECT unnest({list(TAUS)}) AS tau_ms)")
def samples_x_tau(spark, d):
    return dyads.samples_x_tau(samples(spark, d), TAUS).select("file_id", "i", "tau_ms")


@query("id_cross_check", ctes(["v_manifest"], DUCKDB) + " SELECT CASE WHEN conv_id % 6 = 0 THEN 'X' || interaction_id ELSE interaction_id END AS interaction_id, interaction_id AS derived_id, conv_id % 6 = 0 AS mismatch FROM v_manifest")
def id_cross_check(spark, d):
    m = fixture(spark, d, "v_manifest").withColumn("interaction_id", F.when(F.col("conv_id") % 6 == 0, F.concat(F.lit("X"), "interaction_id")).otherwise(F.col("interaction_id")))
    return dyads.id_cross_check(m).select("interaction_id", "derived_id", "mismatch")


@query("dedupe_prefer", ctes(["v_manifest"], DUCKDB) + " SELECT interaction_id, 'poc' AS origin FROM v_manifest WHERE conv_id % 4 = 0 UNION ALL SELECT interaction_id, 'new' FROM v_manifest WHERE conv_id % 4 <> 0")
def dedupe_prefer(spark, d):
    m = fixture(spark, d, "v_manifest")
    return dyads.dedupe_prefer(m.where("conv_id % 4 = 0").select("interaction_id", F.lit("poc").alias("origin")), m.select("interaction_id", F.lit("new").alias("origin")), "interaction_id")


@query("group_attr_lookup", _ROLE + " SELECT sample_key, coalesce(m.relationship, 'unknown') AS relationship FROM rs LEFT JOIN (SELECT * FROM v_manifest WHERE conv_id % 8 <> 0) m USING (interaction_id)")
def group_attr_lookup(spark, d):
    return dyads.group_attr_lookup(_role_samples(spark, d), fixture(spark, d, "v_manifest").where("conv_id % 8 <> 0"), "relationship").select("sample_key", "relationship")


@query(
    "metadata_enrich",
    """WITH p AS (SELECT c_custkey, 'V' || printf('%02d', c_nationkey) AS vendor, printf('%06d', c_custkey) AS participant FROM customer),
look AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'V' ELSE '' END || printf('%02d', c_nationkey) AS v, CASE WHEN c_custkey % 3 = 0 THEN printf('%06d', c_custkey) ELSE CAST(c_custkey AS VARCHAR) END AS q, c_mktsegment AS attribute FROM customer WHERE c_custkey % 5 <> 0)
SELECT printf('D%06d', p.c_custkey) AS interaction_id, n.n_name AS relationship, look.attribute FROM p LEFT JOIN nation n ON 'V' || printf('%02d', n.n_nationkey) = p.vendor LEFT JOIN look ON look.v IN (p.vendor, substr(p.vendor, 2)) AND look.q IN (p.participant, CAST(p.c_custkey AS VARCHAR))""",
)
def metadata_enrich(spark, d):
    c, n = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/nation.parquet")
    v = lambda k: F.concat(F.lit("V"), F.format_string("%02d", F.col(k)))
    rows = c.select(F.format_string("D%06d", "c_custkey").alias("interaction_id"), F.lit("h").alias("prompt_hash"), v("c_nationkey").alias("vendor"), F.lit("1").alias("session"), F.format_string("%06d", "c_custkey").alias("participant"))
    inter = spark.createDataFrame([("h", "walk")], "prompt_hash string, prompt string")
    rel = n.select(v("n_nationkey").alias("vendor"), F.lit("1").alias("session"), F.col("n_name").alias("relationship"))
    bare = F.format_string("%02d", "c_nationkey")
    people = c.where("c_custkey % 5 <> 0").select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("V"), bare)).otherwise(bare).alias("vendor"), F.when(F.col("c_custkey") % 3 == 0, F.format_string("%06d", "c_custkey")).otherwise(F.col("c_custkey").cast("string")).alias("participant"), F.col("c_mktsegment").alias("attribute"))
    return dyads.metadata_enrich(rows, inter, rel, people).select("interaction_id", "relationship", "attribute")


_KINDS = {"click": "IS", "view": "R", "purchase": "V"}
_ANN = "ann AS (SELECT user_id, day(ts) AS day, event_id, CASE event_type WHEN 'click' THEN 'IS' WHEN 'view' THEN 'R' WHEN 'purchase' THEN 'V' END AS kind, props AS annotation FROM events WHERE event_type IN ('click', 'view', 'purchase'))"


def _annotations(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where(F.col("event_type").isin(*_KINDS))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.col("event_type"))
    return e.select("user_id", F.day("ts").alias("day"), "event_id", kind.alias("kind"), F.col("props").alias("annotation"))


@query("merge_annotations", f"WITH {_ANN} SELECT user_id, day, " + ", ".join(f"arg_max(annotation, event_id) FILTER (kind = '{k}') AS {k.lower()}_text" for k in ("IS", "R", "V")) + " FROM ann GROUP BY user_id, day")
def merge_annotations(spark, d):
    return dyads.merge_annotations(_annotations(spark, d), ["user_id", "day"], "event_id")


@query("annotation_coverage", f"WITH {_ANN} SELECT n_nationkey AS interaction_id, CASE WHEN count(DISTINCT user_id) >= 2 THEN 'both' WHEN count(DISTINCT user_id) = 1 THEN 'single' ELSE 'none' END AS annotation_coverage FROM nation LEFT JOIN (SELECT user_id, user_id % 60 AS g FROM ann WHERE kind = 'V') ON g = n_nationkey GROUP BY 1")
def annotation_coverage(spark, d):
    a = _annotations(spark, d).where("kind = 'V'").select((F.col("user_id") % 60).alias("interaction_id"), F.col("user_id").alias("participant_id"))
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("interaction_id"))
    return metrics.annotation_coverage(n, a)


# --- counts over labels --------------------------------------------------------------------------


@query("summarize_samples", with_labels() + " SELECT split, label, count(*) AS n, grouping_id(split, label) AS level FROM labels WHERE tau_ms = 400 GROUP BY CUBE (split, label)")
def summarize_samples(spark, d):
    return metrics.summarize_samples(labels(spark, d, (400,)))


@query("class_weights", with_labels() + ", c AS (SELECT label FROM labels WHERE tau_ms = 400 AND split = 'train') SELECT k.label, CASE WHEN n > 0 THEN (SELECT count(*) FROM c) / (3e0 * n) ELSE 0e0 END AS weight FROM (SELECT unnest([0, 1, 2]) AS label) k LEFT JOIN (SELECT label, count(*) AS n FROM c GROUP BY 1) USING (label)")
def class_weights(spark, d):
    return metrics.class_weights(labels(spark, d, (400,)).where("split = 'train'"))


@query("class_distribution", with_labels() + " SELECT tau_ms, label, count(*) AS n FROM labels WHERE split = 'test' GROUP BY ALL")
def class_distribution(spark, d):
    return metrics.class_distribution(labels(spark, d).where("split = 'test'"), by=["tau_ms"])
