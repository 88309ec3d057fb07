"""Planning and auditing: asset tasks, outcomes, sidecars, registry, configuration and shape rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.scalars import ASSET_BASE, interaction_id

from .small import few
from .topn import first_n

# Fixed values of the rules.
FUSIONS = ("unimodal", "early", "neural_concat", "attention", "self_attention", "cross_attention", "self_cross_attention")
ROLES = ("speaker", "listener")
KINDS = ("spliced", "coordination")
MODES = ("summary", "continuous")
SUMMARY_WIDTH = 19
WINDOW_S = 2.0
SOFT = ("T_mismatch", "missing_file")
STREAMS = {"audio": "wav", "video": "mp4", "vad": "jsonl"}


def plan_asset_tasks(manifest: DataFrame, streams: dict[str, str] | None = None, root: str = "assets") -> DataFrame:
    """A task per dyad, side and stream: url and path. Sides without a file id are skipped; the id
    derived from the file wins over the manifest's, and differing ones are flagged."""
    s = F.array(*[F.struct(F.lit(k).alias("stream"), F.lit(v).alias("ext")) for k, v in (streams or STREAMS).items()])
    sides = F.array(*[F.struct(F.lit(x).alias("side"), F.col(f"file_id_{x}").alias("file_id")) for x in "ab"])
    rows = manifest.select("interaction_id", "label", "split", F.explode(sides).alias("f")).select("interaction_id", "label", "split", "f.*").where(F.coalesce(F.col("file_id"), F.lit("")) != "")
    tasks = rows.select("*", F.explode(s).alias("s")).select("interaction_id", "label", "split", "side", "file_id", "s.*")
    derived = F.coalesce(interaction_id("file_id"), F.col("interaction_id"))
    return tasks.select(
        derived.alias("interaction_id"),
        (derived != F.col("interaction_id")).alias("mismatch"),
        "side",
        "stream",
        "file_id",
        F.concat_ws("/", F.lit(ASSET_BASE), "label", "split", "stream", F.concat_ws(".", "file_id", "ext")).alias("url"),
        F.concat_ws("/", F.lit(root), derived, F.concat_ws(".", "file_id", "ext")).alias("path"),
    )


def task_outcome_class(code: Column, message: Column) -> Column:
    """ok, skipped, dry, missing or failed from an HTTP code and a message."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.rlike("dry"), "dry").when(m.rlike("exists|skip"), "skipped").when(code.isin(404, 403) | m.rlike("not found|missing"), "missing").when(code.between(200, 299), "ok").otherwise("failed")


def feature_sidecar(windows: DataFrame, source_hz: float, target_hz: float, dim: int, window_s: float = WINDOW_S) -> DataFrame:
    """A metadata row per window: ids, bounds, rates, pooling factor, width and frames."""
    return windows.select("file_id", interaction_id("file_id").alias("interaction_id"), "start_s", "end_s", F.lit(source_hz).alias("source_hz"), F.lit(target_hz).alias("target_hz"), F.lit(round(source_hz / target_hz)).alias("pool_factor"), F.lit(dim).alias("feature_dim"), F.lit(round(target_hz * window_s)).alias("n_frames"))


def param_compat(sidecars: DataFrame, requested: dict[str, float]) -> DataFrame:
    """``file_id, param, existing, requested`` of every parameter that differs, in all sidecars."""
    cells = F.array(*[F.struct(F.lit(k).alias("param"), F.col(k).cast("double").alias("existing"), F.lit(float(v)).alias("requested")) for k, v in requested.items()])
    return sidecars.select("file_id", F.explode(cells).alias("c")).select("file_id", "c.*").where(~F.col("existing").eqNullSafe(F.col("requested")))


def registry_audit(registry: DataFrame) -> DataFrame:
    """``modality, rule`` for each broken rule of the modality registry."""
    rules = F.array(
        F.when(F.col("kind").isNull() | F.col("feature_dim").isNull(), F.lit("missing_key")),
        F.when(F.col("kind").isNotNull() & ~F.col("kind").isin(*KINDS), F.lit("bad_kind")),
        F.when((F.col("kind") == "coordination") & ~F.coalesce(F.col("mode"), F.lit("")).isin(*MODES), F.lit("bad_mode")),
        F.when((F.col("kind") == "spliced") & F.col("frame_rate_hz").isNull(), F.lit("missing_rate")),
    )
    return registry.select("modality", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))


def config_audit(experiments: DataFrame, registry: DataFrame, has_summary_source: bool = True) -> DataFrame:
    """``experiment, rule`` for each broken rule. ``experiments``: one row per stream, or one with a
    null modality and stream index for an experiment without streams."""
    r = registry.select("modality", F.lit(True).alias("known"), "kind", "mode", "feature_dim", "frame_rate_hz")
    s = experiments.join(few(r), "modality", "left")
    real = F.col("stream_idx").isNotNull()
    coord = F.col("kind") == "coordination"
    summary = coord & (F.col("mode") == "summary")
    target = F.when((F.col("kind") == "spliced") & F.col("role").isin(*ROLES), F.rint(F.col("frame_rate_hz") * WINDOW_S).cast("long"))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = s.groupBy("experiment").agg(
        F.first("fusion").alias("fusion"),
        F.count(F.when(real, 1)).alias("n"),
        any_(real & F.col("known").isNull()).alias("unknown"),
        any_(real & ~F.coalesce(F.col("role"), F.lit("")).isin(*ROLES)).alias("role"),
        any_(coord & (F.col("role") != "speaker")).alias("coord_role"),
        any_(summary & (F.col("feature_dim") != SUMMARY_WIDTH)).alias("width"),
        any_(coord & ~F.coalesce(F.col("mode"), F.lit("")).isin(*MODES)).alias("mode"),
        any_(coord).alias("coord"),
        any_(summary).alias("summary"),
        F.countDistinct(F.when(target > 0, target)).alias("lengths"),
    )
    f, n = F.col("fusion"), F.col("n")
    rules = {
        "unknown_fusion": ~F.coalesce(f, F.lit("")).isin(*FUSIONS),
        "no_streams": n == 0,
        "unknown_modality": F.col("unknown"),
        "bad_role": F.col("role"),
        "coordination_role": F.col("coord_role"),
        "summary_width": F.col("width"),
        "bad_mode": F.col("mode"),
        "unimodal_streams": (f == "unimodal") & (n > 0) & (n != 1),
        "neural_concat_streams": (f == "neural_concat") & (n > 0) & (n < 2),
        "early_coordination": (f == "early") & F.col("coord"),
        "early_lengths": (f == "early") & (F.col("lengths") > 1),
        "no_summary_source": F.col("summary") & F.lit(not has_summary_source),
    }
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()])
    return g.select("experiment", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("rule"))


def shape_audit(samples: DataFrame, streams: DataFrame, registry: DataFrame, index: DataFrame, coordination: DataFrame | None = None, missing: str = "zeros") -> DataFrame:
    """A row per sample and stream with ``error_kind`` (null if fine) and the observed shape.

    ``streams``: experiment, stream_idx, modality, role; ``registry``: modality, feature_dim,
    frame_rate_hz, and kind and mode (without them all are spliced); ``index``: modality, file_id,
    t, d (null where the header could not be read), candidate (lowest first); ``coordination``:
    sample_key, modality, t, d of the summary rows, one a key. A summary stream looks its row up by
    the sample and expects one row of ``feature_dim``; where it has none, ``missing`` says whether
    that is an error or is filled with zeros of the right shape. ``absent`` marks what was not found.
    """
    for name in ("kind", "mode"):
        if name not in registry.columns:
            registry = registry.withColumn(name, F.lit("spliced" if name == "kind" else None).cast("string"))
    summary = F.coalesce((F.col("kind") == "coordination") & (F.col("mode") == "summary"), F.lit(False))
    rate_t = F.when(F.col("kind") == "spliced", F.rint(F.col("frame_rate_hz") * WINDOW_S).cast("long"))
    rules = streams.join(registry.select("modality", "feature_dim", rate_t.alias("target_t"), summary.alias("_summary")), "modality")
    file_id = F.when(F.col("role") == "speaker", F.col("speaker_file_id")).otherwise(F.col("listener_file_id"))
    asked = samples.crossJoin(rules).withColumn("file_id", file_id)
    first = index.groupBy("modality", "file_id").agg(F.min(F.struct("candidate", "t", "d")).alias("_f")).select("modality", "file_id", F.col("_f.t").alias("_ft"), F.col("_f.d").alias("_fd"), F.lit(True).alias("_file"))
    looked = asked.join(first, ["modality", "file_id"], "left")
    if coordination is None:
        looked = looked.select("*", F.lit(None).cast("long").alias("_ct"), F.lit(None).cast("long").alias("_cd"), F.lit(None).cast("boolean").alias("_row"))
    else:
        looked = looked.join(coordination.select("sample_key", "modality", F.col("t").alias("_ct"), F.col("d").alias("_cd"), F.lit(True).alias("_row")), ["sample_key", "modality"], "left")
    s, dim = F.col("_summary"), F.col("feature_dim")
    absent = F.when(s, F.col("_row").isNull()).otherwise(F.col("_file").isNull())
    t = F.when(s & absent, 1).when(s, F.col("_ct")).otherwise(F.col("_ft")).cast("long")
    d = F.when(s & absent, dim).when(s, F.col("_cd")).otherwise(F.col("_fd")).cast("long")
    shaped = looked.withColumn("absent", absent).withColumn("t", t).withColumn("d", d)
    kind = (
        F.when(s & F.col("absent"), F.lit("summary_csv_key_missing" if missing == "error" else None))
        .when(s & ~(F.col("t").eqNullSafe(F.lit(1)) & F.col("d").eqNullSafe(dim)), "shape_divergence")
        .when(s, None)
        .when(F.col("absent"), "missing_file")
        .when(F.col("t").isNull() | F.col("d").isNull(), "header_read_failed")
        .when(F.col("d") != dim, "feature_dim_mismatch")
        .when(F.col("t") != F.col("target_t"), "T_mismatch")
    )
    return shaped.select("experiment", "stream_idx", "modality", "sample_key", "file_id", "t", "d", "feature_dim", "target_t", "absent", kind.alias("error_kind"))


def stream_summary(audit: DataFrame) -> DataFrame:
    """Per stream: counts, shapes seen, and whether batches would still mix shapes.

    Shapes of another width fail before they meet others; a stream with a rate is cut or padded to
    its length. What then differs is a hazard.
    """
    count = lambda k: F.count(F.when(F.col("error_kind") == k, 1))
    length = F.when(F.col("d") == F.col("feature_dim"), F.coalesce("target_t", "t"))
    return audit.groupBy("experiment", "stream_idx", "modality").agg(
        F.count("*").alias("n_samples"),
        F.countDistinct("t", "d").alias("n_shapes"),
        F.count(F.when(F.col("absent"), 1)).alias("n_missing"),
        count("feature_dim_mismatch").alias("n_dim_mismatch"),
        count("T_mismatch").alias("n_t_mismatch"),
        count("shape_divergence").alias("n_divergent"),
        (F.countDistinct(length) > 1).alias("stack_hazard"),
    )


def audit_verdict(errors: DataFrame) -> DataFrame:
    """Per experiment: hard and soft errors (unknown kinds are hard), and PASS or FAIL."""
    soft = F.col("error_kind").isin(*SOFT)
    bad = F.col("error_kind").isNotNull()
    return errors.groupBy("experiment").agg(F.count(F.when(bad & ~soft, 1)).alias("n_hard"), F.count(F.when(bad & soft, 1)).alias("n_soft")).withColumn("verdict", F.when(F.col("n_hard") > 0, "FAIL").otherwise("PASS"))


def error_examples(errors: DataFrame, most: int = 5) -> DataFrame:
    """At most ``most`` rows per experiment and kind of error, by sample and stream."""
    return first_n(errors.where("error_kind IS NOT NULL"), ["experiment", "error_kind"], ["sample_key", "stream_idx"], most, "n")


def empty_source_check(manifest: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dyads of which both sides have a non-empty file, and the others with the sides at fault."""
    full = index.where("bytes > 0").select("file_id").distinct()
    looked = manifest
    for side in "ab":
        looked = looked.join(full.select(F.col("file_id").alias(f"file_id_{side}"), F.lit(True).alias(f"_{side}")), f"file_id_{side}", "left")
    fault = F.concat(F.when(F.col("_a").isNull(), "a").otherwise(""), F.when(F.col("_b").isNull(), "b").otherwise(""))
    marked = looked.withColumn("fault", fault).drop("_a", "_b")
    return marked.where("fault = ''").drop("fault"), marked.where("fault <> ''")
