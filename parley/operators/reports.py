"""Rankings, curves over the horizon, and report tables. Inputs are small result tables (one row
per experiment and tau), so their windows may lack a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .small import few
from .topn import first_n_by_hash

# The order of the experiments within each block, and the blocks' titles.
BLOCK_ORDER = {
    "standard": ["cpc_both_early", "cpc_both_neural_concat", "cpc_speaker_of_listener", "cpc_speaker_of_dyad", "full_dyad"],
    "ssa": ["cpc_both_attention", "of_speaker_of_listener_attention", "cpc_speaker_of_listener_attention", "cpc_speaker_of_dyad_attention", "full_dyad_attention"],
    "sca": ["cpc_speaker_of_listener_cross_attention", "cpc_speaker_of_listener_self_cross_attention"],
    "coordination": ["cpc_speaker_plus_coordination", "openface_with_coord_neural_concat", "openface_BOTH_with_coord_neural_concat", "cpc_speaker_of_listener_coord", "cpc_speaker_both_faces_coord", "full_dyad_plus_coordination"],
    "csa": ["cpc_speaker_coord_self_attention", "cpc_speaker_cpc_listener_coord_self_attention", "cpc_speaker_of_speaker_coord_self_attention", "openface_coord_self_attention", "cpc_speaker_of_listener_coord_self_attention", "full_dyad_plus_coordination_self_attention"],
}
BLOCK_TITLES = {"standard": "Standard", "ssa": "Standard + Self-Attention", "sca": "Standard + Cross-Attention", "coordination": "Coordination", "csa": "Coordination + Self-Attention"}
LEADERBOARD_METRICS = ("macro_f1", "h_f1", "y_f1", "b_f1", "macro_recall", "h_recall", "y_recall", "b_recall")


def block_order(spark: SparkSession) -> DataFrame:
    """``block, experiment, position``: the fixed order as a table."""
    rows = [(b, e, i) for b, names in BLOCK_ORDER.items() for i, e in enumerate(names, 1)]
    return spark.createDataFrame(rows, "block string, experiment string, position int")


def block_titles(spark: SparkSession) -> DataFrame:
    """``block, block_position, title``."""
    return spark.createDataFrame([(b, i, t) for i, (b, t) in enumerate(BLOCK_TITLES.items(), 1)], "block string, block_position int, title string")


def rank_by_metric(df: DataFrame, metric: str, key: str, by: list[str] | None = None) -> DataFrame:
    """1-based rank by the metric, descending; ties by ``key``."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc_nulls_last(metric), key)
    return df.withColumn("rank", F.row_number().over(w))


def tau_auc(sweep: DataFrame, metrics: tuple[str, ...], by: list[str], x: str = "tau_ms") -> DataFrame:
    """``by`` and ``auc_<metric>``: trapezoid area over linear tau, null where there is one point."""
    w = Window.partitionBy(*by).orderBy(x)
    step = F.col(x) - F.lag(x).over(w)
    parts = sweep.select(*by, *[(step * (F.col(m) + F.lag(m).over(w)) / 2.0).alias(f"a_{m}") for m in metrics])
    return parts.groupBy(*by).agg(*[F.when(F.count("*") > 1, F.sum(f"a_{m}")).alias(f"auc_{m}") for m in metrics])


def with_tau_auc(sweep: DataFrame, metrics: tuple[str, ...], by: list[str], x: str = "tau_ms") -> DataFrame:
    """The area repeated on each row of the sweep."""
    return sweep.join(tau_auc(sweep, metrics, by, x), by)


def per_experiment_summary(sweep: DataFrame, attributes: tuple[str, ...], metrics: tuple[str, ...] = ("macro_f1", "macro_recall"), tau: int = 400) -> DataFrame:
    """Per experiment: attributes of its first row by tau, areas, and metrics at ``tau``."""
    first = [F.min(F.struct("tau_ms", a))[a].alias(a) for a in attributes]
    at = [F.max(F.when(F.col("tau_ms") == tau, F.col(m))).alias(f"{m}_at_{tau}") for m in metrics]
    return sweep.groupBy("experiment").agg(*first, *at).join(tau_auc(sweep, metrics, ["experiment"]), "experiment")


def top_n_by_auc(summary: DataFrame, metric: str, n: int = 3) -> DataFrame:
    """The n experiments with the largest area; those without one are left out."""
    return summary.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), "experiment").limit(n)


def tau_curves(sweep: DataFrame, top: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Series of the chosen experiments, by experiment and tau."""
    return sweep.join(top.select("experiment"), "experiment", "left_semi").select("experiment", "tau_ms", *columns).orderBy("experiment", "tau_ms")


def _is_max(metrics: tuple[str, ...], w) -> list[Column]:
    return [F.coalesce(F.col(m) == F.max(m).over(w), F.lit(False)).alias(f"is_max_{m}") for m in metrics]


def block_table(t400: DataFrame, order: DataFrame, metrics: tuple[str, ...], block: str | None = None) -> DataFrame:
    """Rows of a block (or of all) in fixed order, each metric flagged where it is the block's largest.

    ``order``: block, experiment, position.
    """
    rows = t400.join(few(order), ["block", "experiment"])
    rows = rows if block is None else rows.where(F.col("block") == block)
    return rows.select("block", "position", "experiment", *metrics, *_is_max(metrics, Window.partitionBy("block"))).orderBy("block", "position")


def leaderboard(t400: DataFrame, metrics: tuple[str, ...] = LEADERBOARD_METRICS, sort: str = "macro_f1", key: str = "experiment") -> DataFrame:
    """All experiments by ``sort``, descending; the maxima come from a one-row aggregate."""
    best = t400.agg(*[F.max(m).alias(f"_max_{m}") for m in metrics])
    rows = rank_by_metric(t400, sort, key).crossJoin(F.broadcast(best))
    flags = [F.coalesce(F.col(m) == F.col(f"_max_{m}"), F.lit(False)).alias(f"is_max_{m}") for m in metrics]
    return rows.select("rank", *t400.columns, *flags).orderBy("rank")


def ablation_suite(t400: DataFrame, order: DataFrame, titles: DataFrame) -> DataFrame:
    """Block, streams and architecture in fixed order; the title stands on a block's first row only.

    ``t400``: block, experiment, and experiment_name (its streams) and arch, null where it lacks
    them; ``order``: block, experiment, position; ``titles``: block, block_position, title.
    """
    given = lambda c: (F.col(c) if c in t400.columns else F.lit(None)).cast("string")
    rows = t400.join(few(order), ["block", "experiment"]).join(few(titles), "block")
    first = F.row_number().over(Window.partitionBy("block").orderBy("position")) == 1
    return rows.select("block_position", "position", F.when(first, F.col("title")).otherwise("").alias("block_cell"), "experiment", given("experiment_name").alias("streams"), given("arch").alias("architecture")).orderBy("block_position", "position")


def best_epoch(history: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """The epoch with the largest metric, the first of several."""
    top = F.max(F.struct(F.col(metric), (-F.col("epoch")).alias("_e")))
    return history.groupBy(*by).agg(top.alias("_t")).select(*by, (-F.col("_t._e")).alias("best_epoch"), F.col(f"_t.{metric}").alias("best_value"))


def early_stop_epoch(history: DataFrame, metric: str, by: list[str], patience: int = 4) -> DataFrame:
    """The epoch at which ``patience`` epochs have passed without a strict improvement, else the last."""
    w = Window.partitionBy(*by).orderBy("epoch")
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = before.isNull() | (F.col(metric) > before)
    marked = history.withColumn("_n", F.row_number().over(w)).withColumn("_up", better)
    since = marked.withColumn("_since", F.col("_n") - F.max(F.when(F.col("_up"), F.col("_n"))).over(w))
    return since.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("_since") >= patience, F.col("epoch"))), F.max("epoch")).alias("stop_epoch"), F.bool_or(F.col("_since") >= patience).alias("stopped"))


def cap_per_split(samples: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The first n rows of each split in a seeded hash order, the same in every run."""
    return first_n_by_hash(samples, ["split"], n, key, seed)
