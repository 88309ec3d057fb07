"""Queries over the graph and task fixtures: components, splits, planning, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import audit, dyads, graphs, metrics, splits

from .fixtures import DUCKDB, ctes, fixture
from .q_labels import _ROLE, _role_samples
from .registry import query

# The greedy fold, component by component; within a size the splits then go to the components by id.
PACKED = """o AS (SELECT component, size, row_number() OVER (ORDER BY size DESC, component) AS k, row_number() OVER (PARTITION BY size ORDER BY component) AS place FROM (SELECT component, count(*) AS size FROM comp GROUP BY 1) s),
target AS (SELECT n, CAST(round_even(0.7e0 * n, 0) AS BIGINT) AS t1, CAST(round_even(0.15e0 * n, 0) AS BIGINT) AS t2 FROM (SELECT count(*) AS n FROM comp) c),
fold AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS size, 'none' AS split, t1 AS a, t2 AS b, n - t1 - t2 AS c FROM target UNION ALL
  SELECT k, size, pick, CASE WHEN pick = 'train' THEN a - size ELSE a END, CASE WHEN pick = 'val' THEN b - size ELSE b END, CASE WHEN pick = 'test' THEN c - size ELSE c END
  FROM (SELECT o.k, o.size, f.a, f.b, f.c, CASE WHEN f.a >= f.b AND f.a >= f.c THEN 'train' WHEN f.b >= f.c THEN 'val' ELSE 'test' END AS pick FROM fold f JOIN o ON o.k = f.k + 1) p),
packed AS (SELECT o.component, g.split FROM o JOIN (SELECT size, split, row_number() OVER (PARTITION BY size ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS place FROM fold WHERE k > 0) g USING (size, place))"""

# Components of the customer chains are exactly the groups, so plain SQL names them.
COMPONENTS = "comp AS (SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component FROM customer)"


@query("connected_components", f"WITH {COMPONENTS} SELECT node, component FROM comp")
def connected_components(spark, d):
    return graphs.connected_components(fixture(spark, d, "g_edges"))


def _interactions(spark, d):
    e = fixture(spark, d, "g_edges")
    return e.select(F.concat(F.lit("I"), F.col("src").cast("string")).alias("interaction_id"), F.col("dst").alias("participant_a"), F.col("src").alias("participant_b"))


@query("pack_splits", f"WITH RECURSIVE {COMPONENTS}, {PACKED} SELECT component, split FROM packed")
def pack_splits(spark, d):
    comp = graphs.connected_components(fixture(spark, d, "g_edges"))
    return splits.pack_splits(comp.groupBy("component").agg(F.count("*").alias("size")))


@query("build_manifest", f"WITH RECURSIVE {COMPONENTS}, {PACKED} SELECT m.*, packed.split FROM packed JOIN (SELECT 'I' || CAST(c_custkey AS VARCHAR) AS interaction_id, c_custkey AS participant_a, coalesce(lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey), c_custkey) AS participant_b, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component, CASE WHEN c_custkey % 4 = 0 THEN 'poc' ELSE 'new' END AS origin FROM customer) m USING (component)")
def build_manifest(spark, d):
    pool = _interactions(spark, d)
    preferred = pool.where("participant_b % 4 = 0").withColumn("origin", F.lit("poc"))
    m = splits.build_manifest(pool.withColumn("origin", F.lit("new")), preferred=preferred)
    return m.select("interaction_id", "participant_a", "participant_b", "component", "origin", "split")


@query("verify_disjoint", "WITH p AS (SELECT o_custkey AS participant, CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM orders) SELECT participant, count(DISTINCT split) AS n_splits FROM p GROUP BY 1 HAVING count(DISTINCT split) > 1")
def verify_disjoint(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    m = o.select(F.col("o_custkey").alias("participant_a"), F.col("o_custkey").alias("participant_b"), F.when(F.col("o_orderkey") % 10 < 7, "train").when(F.col("o_orderkey") % 10 < 8, "val").otherwise("test").alias("split"))
    return splits.verify_disjoint(m)


@query("component_histogram", f"WITH {COMPONENTS} SELECT size, count(*) AS n_components FROM (SELECT component, count(*) AS size FROM comp GROUP BY 1) GROUP BY 1")
def component_histogram(spark, d):
    return metrics.component_histogram(graphs.connected_components(fixture(spark, d, "g_edges")))


@query("pool_summary", ctes(["v_manifest"], DUCKDB) + ", t AS (SELECT split, relationship, count(*) AS n FROM v_manifest GROUP BY GROUPING SETS ((split), (split, relationship))) SELECT split, relationship, n, CASE split WHEN 'train' THEN 70 WHEN 'val' THEN 15 ELSE 15 END AS target FROM t")
def pool_summary(spark, d):
    m = fixture(spark, d, "v_manifest")
    targets = spark.createDataFrame([("train", 70), ("val", 15), ("test", 15)], "split string, target int")
    return metrics.pool_summary(m.select("interaction_id", "relationship"), m.select("interaction_id", "split"), targets)


@query(
    "pool_report",
    ctes(["v_manifest"], DUCKDB) + """, m AS (SELECT split, relationship, CASE WHEN conv_id % 3 = 0 THEN 'dev' ELSE 'train' END AS seamless_split FROM v_manifest),
t AS (SELECT NULL AS split, NULL AS attribute, NULL AS value, count(*) AS n FROM m UNION ALL SELECT NULL, 'seamless_split', seamless_split, count(*) FROM m GROUP BY 3
  UNION ALL SELECT split, NULL, NULL, count(*) FROM m GROUP BY 1 UNION ALL SELECT split, 'seamless_split', seamless_split, count(*) FROM m GROUP BY 1, 3 UNION ALL SELECT split, 'relationship', relationship, count(*) FROM m GROUP BY 1, 3)
SELECT split, attribute, value, n, CASE WHEN split = 'train' THEN 70 WHEN split IN ('val', 'test') THEN 15 END AS target FROM t""",
)
def pool_report(spark, d):
    m = fixture(spark, d, "v_manifest").withColumn("seamless_split", F.when(F.col("conv_id") % 3 == 0, "dev").otherwise("train"))
    targets = spark.createDataFrame([("train", 70), ("val", 15), ("test", 15)], "split string, target int")
    return metrics.pool_report(m.select("interaction_id", "seamless_split", "relationship"), m.select("interaction_id", "split"), targets)


# --- tasks ---------------------------------------------------------------------------------------

_BASE = audit.ASSET_BASE


@query("plan_asset_tasks", ctes(["v_files"], DUCKDB) + f", s AS (SELECT unnest(['audio', 'video', 'vad']) AS stream, unnest(['wav', 'mp4', 'jsonl']) AS ext) SELECT interaction_id, false AS mismatch, CASE WHEN file_id LIKE '%P0001' THEN 'a' ELSE 'b' END AS side, stream, file_id, '{_BASE}/naturalistic/' || split || '/' || stream || '/' || file_id || '.' || ext AS url, 'assets/' || interaction_id || '/' || file_id || '.' || ext AS path FROM v_files, s")
def plan_asset_tasks(spark, d):
    return audit.plan_asset_tasks(fixture(spark, d, "v_manifest"))


_OUT = ctes(["v_files"], DUCKDB) + ", o AS (SELECT file_id, CASE conv_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'skipped' WHEN 2 THEN 'missing' WHEN 3 THEN 'failed' ELSE 'dry' END AS status, CASE WHEN conv_id % 5 = 0 THEN 1000 + conv_id ELSE 0 END AS bytes, CASE WHEN file_id LIKE '%P0001' THEN 'audio' ELSE 'vad' END AS stream FROM v_files)"


def _outcomes(spark, d):
    f = fixture(spark, d, "v_files")
    k = F.col("conv_id") % 5
    code = F.when(k == 0, 200).when(k == 2, 404).when(k == 3, 500)
    message = F.when(k == 1, "already exists").when(k == 4, "DRY run").otherwise("")
    return f.select("file_id", audit.task_outcome_class(code, message).alias("status"), F.when(k == 0, 1000 + F.col("conv_id")).otherwise(F.lit(0)).alias("bytes"), F.when(F.col("file_id").endswith("P0001"), "audio").otherwise("vad").alias("stream"))


@query("task_outcome_class", _OUT + " SELECT file_id, status FROM o")
def task_outcome_class(spark, d):
    return _outcomes(spark, d).select("file_id", "status")


@query("task_status_rollup", _OUT + " SELECT stream, count(*) AS n, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in metrics.STATUSES) + ", CAST(sum(bytes) AS BIGINT) AS bytes, sum(bytes) / 1048576e0 AS mib FROM o GROUP BY stream")
def task_status_rollup(spark, d):
    return metrics.task_status_rollup(_outcomes(spark, d))


@query("feature_sidecar", ctes(["t_assets"], DUCKDB) + " SELECT file_id, regexp_extract(file_id, '^(.*)_([^_]*)$', 1) AS interaction_id, 0e0 AS start_s, 2e0 AS end_s, 100e0 AS source_hz, 20e0 AS target_hz, 5 AS pool_factor, 256 AS feature_dim, 40 AS n_frames FROM t_assets")
def feature_sidecar(spark, d):
    w = fixture(spark, d, "t_assets").select("file_id", F.lit(0.0).alias("start_s"), F.lit(2.0).alias("end_s"))
    return audit.feature_sidecar(w, 100.0, 20.0, 256)


@query("param_compat", ctes(["t_assets"], DUCKDB) + " SELECT file_id, 't' AS param, CAST(t AS DOUBLE) AS existing, 200e0 AS requested FROM t_assets WHERE t <> 200 UNION ALL SELECT file_id, 'd', CAST(d AS DOUBLE), 256e0 FROM t_assets WHERE d <> 256")
def param_compat(spark, d):
    return audit.param_compat(fixture(spark, d, "t_assets"), {"t": 200, "d": 256})


# --- audits --------------------------------------------------------------------------------------


@query("registry_audit", "SELECT c_name AS modality, rule FROM customer, (SELECT unnest(['bad_kind', 'bad_mode', 'missing_rate', 'missing_key']) AS rule) r WHERE (rule = 'bad_kind' AND c_custkey % 4 = 1) OR (rule = 'bad_mode' AND c_custkey % 4 = 2 AND c_custkey % 3 = 0) OR (rule = 'missing_rate' AND c_custkey % 4 = 0 AND c_custkey % 5 = 0) OR (rule = 'missing_key' AND c_custkey % 4 = 3)")
def registry_audit(spark, d):
    c, k = spark.read.parquet(f"{d}/customer.parquet"), F.col("c_custkey")
    kind = F.when(k % 4 == 0, "spliced").when(k % 4 == 1, "odd").when(k % 4 == 2, "coordination")
    r = c.select(F.col("c_name").alias("modality"), kind.alias("kind"), F.when(k % 3 != 0, "summary").alias("mode"), F.lit(19).alias("feature_dim"), F.when(k % 5 != 0, 30.0).alias("frame_rate_hz"))
    return audit.registry_audit(r)


_CONFIG = """WITH e AS (SELECT grp, CASE grp % 5 WHEN 0 THEN 'early' WHEN 1 THEN 'unimodal' WHEN 2 THEN 'neural_concat' WHEN 3 THEN 'magic' ELSE 'self_attention' END AS fusion,
  CASE k % 4 WHEN 0 THEN 'audio' WHEN 1 THEN 'face' WHEN 2 THEN 'wcc' ELSE 'none' END AS modality, CASE WHEN k % 3 = 0 THEN 'listener' ELSE 'speaker' END AS role FROM (SELECT o_custkey AS grp, o_orderkey AS k FROM orders) s),
g AS (SELECT 'C' || grp AS experiment, any_value(fusion) AS fusion, count(*) AS n, bool_or(modality = 'none') AS unknown, bool_or(modality = 'wcc' AND role <> 'speaker') AS cr, bool_or(modality = 'wcc') AS coord, count(DISTINCT modality) FILTER (modality IN ('audio', 'face')) AS lengths FROM e GROUP BY 1)"""
_RULES = {"unknown_fusion": "fusion = 'magic'", "unknown_modality": "unknown", "coordination_role": "cr", "unimodal_streams": "fusion = 'unimodal' AND n <> 1", "neural_concat_streams": "fusion = 'neural_concat' AND n < 2", "early_coordination": "fusion = 'early' AND coord", "early_lengths": "fusion = 'early' AND lengths > 1", "no_summary_source": "coord"}


@query("config_audit", _CONFIG + " " + " UNION ALL ".join(f"SELECT experiment, '{k}' AS rule FROM g WHERE {v}" for k, v in _RULES.items()))
def config_audit(spark, d):
    o, k = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey")
    fusion = F.element_at(F.array(*[F.lit(x) for x in ("early", "unimodal", "neural_concat", "magic", "self_attention")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    modality = F.element_at(F.array(*[F.lit(x) for x in ("audio", "face", "wcc", "none")]), (k % 4 + 1).cast("int"))
    e = o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("experiment"), fusion.alias("fusion"), k.cast("int").alias("stream_idx"), modality.alias("modality"), F.when(k % 3 == 0, "listener").otherwise("speaker").alias("role"))
    reg = spark.createDataFrame([("audio", "spliced", None, 256, 100.0), ("face", "spliced", None, 23, 30.0), ("wcc", "coordination", "summary", 19, None)], "modality string, kind string, mode string, feature_dim int, frame_rate_hz double")
    return audit.config_audit(e, reg, has_summary_source=False)


# Two streams of files and one of summary rows, of which every third has another width.
_SHAPES = _ROLE + """, streams AS (SELECT 0 AS stream_idx, 'speaker' AS role UNION ALL SELECT 1, 'listener'),
aud AS (SELECT 'x1' AS experiment, stream_idx, 'audio' AS modality, sample_key, CASE WHEN role = 'speaker' THEN speaker_file_id ELSE listener_file_id END AS file_id FROM rs, streams),
files AS (SELECT aud.*, a.t, a.d, a.file_id IS NULL AS absent, CASE WHEN a.file_id IS NULL THEN 'missing_file' WHEN a.bytes = 0 THEN 'header_read_failed' WHEN a.d <> 256 THEN 'feature_dim_mismatch' WHEN a.t <> 200 THEN 'T_mismatch' END AS error_kind FROM aud LEFT JOIN (SELECT file_id, bytes, CASE WHEN bytes > 0 THEN t END AS t, CASE WHEN bytes > 0 THEN d END AS d FROM t_assets) a USING (file_id)),
rows19 AS (SELECT 'x1' AS experiment, 2 AS stream_idx, 'wcc' AS modality, sample_key, speaker_file_id AS file_id, 1 AS t, CASE WHEN conv_id % 3 = 0 THEN 18 ELSE 19 END AS d, conv_id IS NULL AS absent, CASE WHEN conv_id IS NULL THEN 'summary_csv_key_missing' WHEN conv_id % 3 = 0 THEN 'shape_divergence' END AS error_kind FROM rs LEFT JOIN t_assets a ON a.file_id = rs.speaker_file_id),
err AS (SELECT * FROM files UNION ALL SELECT * FROM rows19)"""


def _audit(spark, d):
    streams = spark.createDataFrame([("x1", 0, "audio", "speaker"), ("x1", 1, "audio", "listener"), ("x1", 2, "wcc", "speaker")], "experiment string, stream_idx int, modality string, role string")
    reg = spark.createDataFrame([("audio", "spliced", None, 256, 100.0), ("wcc", "coordination", "summary", 19, None)], "modality string, kind string, mode string, feature_dim int, frame_rate_hz double")
    full = F.col("bytes") > 0
    assets = fixture(spark, d, "t_assets")
    index = assets.select(F.lit("audio").alias("modality"), "file_id", F.when(full, F.col("t")).alias("t"), F.when(full, F.col("d")).alias("d"), F.lit(0).alias("candidate"))
    samples = _role_samples(spark, d)
    width = F.when(F.col("conv_id") % 3 == 0, 18).otherwise(19)
    coordination = samples.join(assets.select(F.col("file_id").alias("speaker_file_id"), width.alias("d")), "speaker_file_id").select("sample_key", F.lit("wcc").alias("modality"), F.lit(1).alias("t"), "d")
    return audit.shape_audit(samples, streams, reg, index, coordination, missing="error")


@query("shape_audit", _SHAPES + " SELECT experiment, stream_idx, modality, sample_key, file_id, CAST(t AS BIGINT) AS t, CAST(d AS BIGINT) AS d, absent, error_kind FROM err")
def shape_audit(spark, d):
    return _audit(spark, d).drop("feature_dim", "target_t")


@query("stream_summary", _SHAPES + " SELECT experiment, stream_idx, modality, count(*) AS n_samples, count(DISTINCT CASE WHEN t IS NOT NULL THEN t * 1000 + d END) AS n_shapes, count(*) FILTER (absent) AS n_missing, " + ", ".join(f"count(*) FILTER (error_kind = '{k}') AS {n}" for k, n in (("feature_dim_mismatch", "n_dim_mismatch"), ("T_mismatch", "n_t_mismatch"), ("shape_divergence", "n_divergent"))) + ", false AS stack_hazard FROM err GROUP BY ALL")
def stream_summary(spark, d):
    return audit.stream_summary(_audit(spark, d))


@query("audit_verdict", _SHAPES + " SELECT experiment, count(*) FILTER (error_kind IS NOT NULL AND error_kind NOT IN ('T_mismatch', 'missing_file')) AS n_hard, count(*) FILTER (error_kind IN ('T_mismatch', 'missing_file')) AS n_soft, CASE WHEN count(*) FILTER (error_kind NOT IN ('T_mismatch', 'missing_file')) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM err GROUP BY experiment")
def audit_verdict(spark, d):
    return audit.audit_verdict(_audit(spark, d))


@query("error_examples", _SHAPES + " SELECT error_kind, sample_key, stream_idx, n FROM (SELECT *, row_number() OVER (PARTITION BY experiment, error_kind ORDER BY sample_key, stream_idx) AS n FROM err WHERE error_kind IS NOT NULL) WHERE n <= 5")
def error_examples(spark, d):
    return audit.error_examples(_audit(spark, d)).select("error_kind", "sample_key", "stream_idx", "n")


@query("empty_source_check", ctes(["v_manifest", "t_assets"], DUCKDB) + ", f AS (SELECT file_id FROM t_assets WHERE bytes > 0) SELECT interaction_id, CASE WHEN file_id_a IN (SELECT file_id FROM f) THEN '' ELSE 'a' END || CASE WHEN file_id_b IN (SELECT file_id FROM f) THEN '' ELSE 'b' END AS fault FROM v_manifest")
def empty_source_check(spark, d):
    ok, bad = audit.empty_source_check(fixture(spark, d, "v_manifest"), fixture(spark, d, "t_assets"))
    return ok.select("interaction_id", F.lit("").alias("fault")).unionByName(bad.select("interaction_id", "fault"))


@query("last_wins", "SELECT c_nationkey, max(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def last_wins(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_nationkey", "c_custkey")
    return dyads.last_wins(c, ["c_nationkey"], F.col("c_custkey"))
