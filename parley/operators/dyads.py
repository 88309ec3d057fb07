"""Joins around dyads: perspectives, samples, windows, coordination rows, metadata, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.scalars import interaction_id, key_end_s, key_file_id, key_start_s


def perspectives(manifest: DataFrame, keep: list[str]) -> DataFrame:
    """Each dyad twice: ``file_id`` (speaker), ``other_file_id`` (listener), and the kept columns."""
    sides = F.array(*[F.struct(F.col(f"file_id_{x}").alias("file_id"), F.col(f"file_id_{y}").alias("other_file_id"), F.lit(x).alias("role")) for x, y in ("ab", "ba")])
    return manifest.select(*keep, F.explode(sides).alias("s")).select(*keep, "s.*")


def enumerate_samples(manifest: DataFrame, labels: DataFrame, classes: tuple[int, ...] = (0, 1, 2), window_s: float = 2.0) -> DataFrame:
    """Labels of the training classes with both roles and window bounds; unknown speakers go."""
    look = perspectives(manifest, ["interaction_id", "split"])
    rows = labels.where(F.col("label").isin(*classes)).select("sample_key", "tau_ms", "label", key_file_id("sample_key").alias("file_id"), key_start_s("sample_key", window_s).alias("start_s"), key_end_s("sample_key").alias("end_s"))
    return rows.join(look, "file_id").select("sample_key", "tau_ms", "label", "interaction_id", F.col("file_id").alias("speaker_file_id"), F.col("other_file_id").alias("listener_file_id"), "split", "start_s", "end_s")


def match_windows(samples: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples with the feature file of both roles, and one row of counts of what is missing.

    ``index``: ``file_id, start_ms, end_ms, path``. Windows meet on whole milliseconds.
    """
    ms = lambda c: F.rint(F.col(c) * 1000.0).cast("long")
    keyed = samples.withColumn("start_ms", ms("start_s")).withColumn("end_ms", ms("end_s"))
    for role in ("speaker", "listener"):
        side = index.select(F.col("file_id").alias(f"{role}_file_id"), "start_ms", "end_ms", F.col("path").alias(f"{role}_path"))
        keyed = keyed.join(side, [f"{role}_file_id", "start_ms", "end_ms"], "left")
    missing = keyed.agg(*[F.count(F.when(F.col(f"{r}_path").isNull(), 1)).alias(f"missing_{r}") for r in ("speaker", "listener")])
    return keyed.dropna(subset=["speaker_path", "listener_path"]), missing


def attach_coordination(samples: DataFrame, rows: DataFrame, columns: list[str], keys: list[str], missing: str = "zeros") -> DataFrame:
    """Samples with coordination columns; absent rows become zeros or an error."""
    joined = samples.join(rows.select(*keys, *columns, F.lit(True).alias("_found")), keys, "left")
    if missing == "zeros":
        return joined.select(*samples.columns, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])
    check = lambda c: F.when(F.col("_found").isNull(), F.raise_error(F.lit("no coordination row for a sample"))).otherwise(F.col(c))
    return joined.select(*samples.columns, *[check(c).alias(c) for c in columns])


def attach_continuous(samples: DataFrame, layouts: list[DataFrame], keys: list[str], dim: int, missing: str = "zeros") -> DataFrame:
    """The first layout (``keys, matrix array<array<double>>``) that has the sample; a wrong width is an error."""
    out = samples
    for i, layout in enumerate(layouts):
        out = out.join(layout.select(*keys, F.col("matrix").alias(f"_m{i}")), keys, "left")
    found = F.coalesce(*[F.col(f"_m{i}") for i in range(len(layouts))])
    zeros = F.array(F.array_repeat(F.lit(0.0), dim)) if missing == "zeros" else F.raise_error(F.lit("no continuous coordination for a sample")).cast("array<array<double>>")
    wide = F.when(F.exists(found, lambda r: F.size(r) != dim), F.raise_error(F.lit("wrong feature width")).cast("array<array<double>>")).otherwise(found)
    return out.select(*samples.columns, F.when(found.isNull(), zeros).otherwise(wide).alias("matrix"))


def label_lookup(rows: DataFrame, labels: DataFrame, key: str = "sample_key") -> DataFrame:
    """Rows with their label, null where there is none."""
    return rows.join(labels.select(key, "label"), key, "left")


def metadata_enrich(dyads: DataFrame, interactions: DataFrame, relationships: DataFrame, participants: DataFrame) -> DataFrame:
    """Left joins of three lookups. A participant is looked up under four spellings, best first:
    vendor with and without ``V``, id as it is and without leading zeros.

    ``dyads``: interaction_id, prompt_hash, vendor, session, participant; ``participants``:
    vendor, participant, attribute.
    """
    bare_v, bare_p = F.regexp_replace("vendor", "^V", ""), F.regexp_replace("participant", "^0+(?=.)", "")
    tries = F.array(*[F.struct(F.lit(n).alias("priority"), v.alias("v"), p.alias("p")) for n, (v, p) in enumerate(((F.col("vendor"), F.col("participant")), (F.col("vendor"), bare_p), (bare_v, F.col("participant")), (bare_v, bare_p)))])
    cand = dyads.select("interaction_id", "participant", F.explode(tries).alias("c")).select("interaction_id", "participant", "c.*")
    look = participants.select(F.col("vendor").alias("v"), F.col("participant").alias("p"), "attribute")
    best = cand.join(look, ["v", "p"]).groupBy("interaction_id", "participant").agg(F.min(F.struct("priority", "attribute"))["attribute"].alias("attribute"))
    return dyads.join(interactions, "prompt_hash", "left").join(relationships, ["vendor", "session"], "left").join(best, ["interaction_id", "participant"], "left")


def merge_annotations(annotations: DataFrame, keys: list[str], order: str, kinds: tuple[str, ...] = ("IS", "R", "V")) -> DataFrame:
    """One row per key, a column per kind; of repeated rows the last by ``order`` wins."""
    last = [F.max(F.when(F.col("kind") == k, F.struct(order, "annotation")))["annotation"].alias(k.lower() + "_text") for k in kinds]
    return annotations.groupBy(*keys).agg(*last)


def group_attr_lookup(df: DataFrame, manifest: DataFrame, field: str, default: str = "unknown") -> DataFrame:
    if field not in manifest.columns:
        return df.withColumn(field, F.lit(default))
    return df.join(manifest.select("interaction_id", field), "interaction_id", "left").withColumn(field, F.coalesce(F.col(field), F.lit(default)))


def dedupe_prefer(preferred: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Both pools; where they share a key the preferred row stays."""
    return preferred.unionByName(other.join(preferred.select(key), key, "left_anti"))


def samples_x_tau(samples: DataFrame, taus: tuple[int, ...]) -> DataFrame:
    return samples.withColumn("tau_ms", F.explode(F.array(*[F.lit(t) for t in taus])))


def id_cross_check(manifest: DataFrame) -> DataFrame:
    """The id derived from a file name against that of the manifest; the derived one wins."""
    derived = interaction_id("file_id_a")
    return manifest.withColumn("derived_id", F.coalesce(derived, F.col("interaction_id"))).withColumn("mismatch", derived.isNotNull() & (derived != F.col("interaction_id")))


def last_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the last by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max(F.struct(order.alias("_o"), *[F.col(c) for c in rest]))
    return df.groupBy(*keys).agg(picked.alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])
