"""Filters, each with what it rejects where that is asked for."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.scalars import key_file_id

from .small import few


def training_class_filter(df: DataFrame, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    return df.where(F.col("label").isin(*classes))


def split_filter(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


def exclude_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``ids`` (a null key stays)."""
    return df.join(ids.select(key), key, "left_anti")


def domain_filter(df: DataFrame, allowed: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Rows with allowed values, and the others with the first column that is at fault as ``reason``."""
    reason = F.coalesce(*[F.when(F.col(c).isNull() | ~F.col(c).isin(*v), F.lit(f"bad_{c}")) for c, v in allowed.items()])
    marked = df.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def both_annotated(filelist: DataFrame) -> DataFrame:
    """Interactions of exactly two annotated naturalistic files, with the files in order."""
    rows = filelist.where((F.col("label") == "naturalistic") & (F.col("has_annotation_3p") == "1"))
    g = rows.groupBy("interaction_id").agg(F.count("*").alias("n"), F.min("file_id").alias("file_id_a"), F.max("file_id").alias("file_id_b"))
    return g.where("n = 2").drop("n")


def complete_samples(samples: DataFrame, streams: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples for which every stream has a file, and the others with what they lack.

    ``streams``: stream_idx, modality, role, exempt; ``index``: modality, file_id (any of a
    stream's candidate paths gives the same row). A stream that is exempt needs no file.
    """
    asked = samples.crossJoin(few(streams))
    file_id = F.when(F.col("role") == "speaker", F.col("speaker_file_id")).otherwise(F.col("listener_file_id"))
    there = index.select("modality", F.col("file_id").alias("_file"), F.lit(True).alias("_there")).distinct()
    looked = asked.withColumn("_file", file_id).join(there, ["modality", "_file"], "left")
    lacks = F.when(~F.col("exempt") & F.col("_there").isNull(), F.concat_ws(":", "role", "modality"))
    verdict = looked.groupBy(*samples.columns).agg(F.array_sort(F.collect_list(lacks)).alias("_m")).withColumn("missing", F.array_join("_m", ",")).drop("_m")
    return verdict.where("missing = ''").drop("missing"), verdict.where("missing <> ''")


def resume_skip(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks without a non-empty output yet."""
    return tasks.join(done.where("bytes > 0").select(key), key, "left_anti")


def fingerprints(inputs: DataFrame, key: str, params: dict[str, str]) -> DataFrame:
    """``key, fingerprint, params``: what the rows of each key and the parameters come down to.

    Sums and counts of 64-bit row hashes under two seeds, combined before the shuffle: the order of
    the rows doesn't matter, their number does.
    """
    rest = sorted(c for c in inputs.columns if c != key)
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.lit(0)
    text = json.dumps(params, sort_keys=True)
    total = lambda seed: F.sum(F.xxhash64(row, F.lit(seed)).cast("decimal(38,0)")).cast("string")
    hashed = F.sha2(F.concat_ws("|", F.count("*").cast("string"), total(1), total(2), F.lit(text)), 256)
    return inputs.groupBy(F.col(key).cast("string").alias(key)).agg(hashed.alias("fingerprint"), F.lit(text).alias("params"))


def resume_plan(now: DataFrame, sidecars: DataFrame, key: str) -> DataFrame:
    """``key, fingerprint, params, reason`` of all keys; those with reason ``done`` need no work.

    ``now``: fingerprints of the inputs at hand; ``sidecars``: those stored beside the outputs. Work
    is to do where there is no sidecar, the output is empty, or inputs or parameters have changed.
    """
    old = sidecars.select(F.col(key).cast("string").alias(key), F.col("fingerprint").alias("_old"), F.col("params").alias("_params"), "n_rows")
    reason = (
        F.when(F.col("_old").isNull(), "no_sidecar")
        .when(F.coalesce("n_rows", F.lit(0)) == 0, "empty_output")
        .when(F.col("_params") != F.col("params"), "changed_parameter")
        .when(F.col("_old") != F.col("fingerprint"), "changed_input")
        .otherwise("done")
    )
    return now.join(old, key, "left").select(key, "fingerprint", "params", reason.alias("reason"))


def finite_counts(array: Column) -> Column:
    """Struct ``n_nan, n_inf, ok`` of a numeric array."""
    nan = F.size(F.filter(array, lambda x: F.isnan(x)))
    inf = F.size(F.filter(array, lambda x: F.abs(x) == float("inf")))
    return F.struct(nan.alias("n_nan"), inf.alias("n_inf"), ((nan == 0) & (inf == 0)).alias("ok"))


def dominant_length(df: DataFrame, group: str, length: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their group's most frequent length (the longer on ties), and the others."""
    n = df.groupBy(group, length).agg(F.count("*").alias("_n")).groupBy(group).agg(F.max(F.struct("_n", length))[length].alias("dominant"))
    marked = df.join(n, group)
    return marked.where(F.col(length) == F.col("dominant")), marked.where(F.col(length) != F.col("dominant")).withColumn("reason", F.lit("length_mismatch"))


def missing_key_report(labels: DataFrame, manifest: DataFrame, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Counts of labels that are not of a training class, not parsed, not in the manifest, or fine."""
    files = manifest.select(F.explode(F.array("file_id_a", "file_id_b")).alias("_f")).distinct().withColumn("_known", F.lit(True))
    fid = key_file_id("sample_key")
    looked = labels.withColumn("_f", fid).join(files, "_f", "left")
    tag = F.when(~F.col("label").isin(*classes), "non_training").when(F.col("_f").isNull(), "parse_failed").when(F.col("_known").isNull(), "not_in_manifest").otherwise("usable")
    return looked.groupBy(tag.alias("tag")).agg(F.count("*").alias("n"))
