"""Writers. Each can be run again: it replaces what it wrote, partition by partition."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import MANIFEST_COLUMNS, PACKED, document_lines


#: Files of each tau, at most.
LABEL_FILES = 32


def _replace(df: DataFrame, path: str, partition: list[str], fmt: str = "parquet") -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).format(fmt).save(path)


def write_labels(labels: DataFrame, path: str, dry_run: bool = False, fmt: str = "parquet") -> None:
    """Labels by tau, sorted by key; a dry run writes nothing.

    As ``object`` each tau is one JSON object with its keys in order, an entry a line. Its files are
    ranges of the keys: the first opens the object, the last closes it, and one after another they
    are its text. ``read_labels`` reads them side by side. As ``json`` each line is an object.
    """
    if dry_run:
        return
    if fmt == "object":
        rows = labels.select("tau_ms", "sample_key", "label").dropDuplicates(["tau_ms", "sample_key"])
        ends = rows.groupBy("tau_ms").agg(F.min("sample_key").alias("_first"), F.max("sample_key").alias("_last"))
        key = F.to_json(F.array("sample_key"))
        entry = F.concat(F.when(F.col("sample_key") == F.col("_first"), "{\n").otherwise(""), F.lit("  "), F.substring(key, F.lit(2), F.length(key) - 2), F.lit(": "), F.col("label").cast("string"), F.when(F.col("sample_key") == F.col("_last"), "\n}").otherwise(","))
        sorted_ = rows.join(ends, "tau_ms").repartitionByRange(LABEL_FILES, "tau_ms", "sample_key").sortWithinPartitions("tau_ms", "sample_key")
        _replace(sorted_.select("tau_ms", entry.alias("value")), path, ["tau_ms"], "text")
        return
    part = F.pmod(F.xxhash64("sample_key"), F.lit(LABEL_FILES))
    rows = labels.repartition("tau_ms", part).sortWithinPartitions("tau_ms", "sample_key")
    if fmt == "json":
        rows = rows.select("tau_ms", F.to_json(F.create_map("sample_key", "label")).alias("value"))
        fmt = "text"
    _replace(rows, path, ["tau_ms"], fmt)


#: Taus and splits are few; a store's folders are read by them alone.
STORE_KEYS = ["split", "tau_ms"]


def write_label_store(labels: DataFrame, path: str) -> None:
    """Labels with all their columns in folders of split and tau; a rerun replaces the folders it writes."""
    part = F.pmod(F.xxhash64("sample_key"), F.lit(LABEL_FILES))
    _replace(labels.repartition(*STORE_KEYS, part), path, STORE_KEYS)


def read_label_store(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The stored labels; filters and joins on split and tau read their folders alone."""
    return spark.read.parquet(path).select(*columns)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


COMMIT = "experiment string, tau_ms int, at long"


def commit_results(results: DataFrame, path: str, experiment: str, tau_ms: int) -> None:
    """Write the rows of one experiment and tau, then record them: readers see all of them or none.

    The rows are staged in a folder of their own, which then becomes the folder of the tau; the
    record, one small file that appears at once, comes last. An attempt that ends before it leaves
    nothing that counts, and a later one replaces what it left.
    """
    spark = results.sparkSession
    staged = f"{path}/staged/{uuid.uuid4().hex}"
    results.drop("experiment", "tau_ms").write.parquet(staged)
    fs, source = _files(spark, staged)
    _, target = _files(spark, f"{path}/results/experiment={experiment}/tau_ms={tau_ms}")
    fs.delete(target, True)
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{staged} can't become {target.toString()}")
    spark.createDataFrame([(experiment, tau_ms, time.time_ns())], COMMIT).coalesce(1).write.mode("append").json(f"{path}/commits")


def commits(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The experiments and taus that are committed (few rows, of a run's configuration)."""
    fs, at = _files(spark, f"{path}/commits")
    if not fs.exists(at):
        return []
    return [(r.experiment, r.tau_ms) for r in spark.read.schema(COMMIT).json(f"{path}/commits").select("experiment", "tau_ms").distinct().orderBy("experiment", "tau_ms").collect()]


def read_committed(spark: SparkSession, path: str) -> DataFrame | None:
    """``experiment, tau_ms`` and the results of all commits; None without any."""
    done = commits(spark, path)
    if not done:
        return None
    return spark.read.option("basePath", f"{path}/results").schema(_stored_schema(spark, path, done[0])).parquet(*[f"{path}/results/experiment={e}/tau_ms={t}" for e, t in done])


def _stored_schema(spark: SparkSession, path: str, one: tuple[str, int]):
    rows = spark.read.parquet(f"{path}/results/experiment={one[0]}/tau_ms={one[1]}")
    return rows.select("*", F.lit("").alias("experiment"), F.lit(0).alias("tau_ms")).schema


#: Folders of a store with sidecars; the hash of a key says which is its own.
STORE_BUCKETS = 128


def _in_bucket(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(STORE_BUCKETS)).cast("int"))


def _swap_bucket(spark: SparkSession, staged: str, path: str, bucket: int) -> None:
    """The staged folder takes the place of the one in the store; its sidecars go first and come last."""
    fs, sidecars = _files(spark, f"{path}/sidecars/_bucket={bucket}")
    fs.delete(sidecars, True)
    for part in ("data", "sidecars"):
        source, target = (_files(spark, f"{top}/{part}/_bucket={bucket}")[1] for top in (staged, path))
        fs.delete(target, True)
        if fs.exists(source) and not fs.rename(source, target):
            raise OSError(f"{source.toString()} can't become {target.toString()}")


def write_with_sidecars(outputs: DataFrame, fingerprints: DataFrame, path: str, key: str) -> None:
    """Replace the outputs of the keys at hand, and their sidecars (``fingerprint`` and rows written).

    Keys share ``STORE_BUCKETS`` folders, so that there are few files however many keys; the other
    keys of a folder are copied. New folders are staged and then take their places one by one, so
    after an interruption one folder at most has no sidecars, and its keys are redone. A store has
    one writer at a time.
    """
    spark = outputs.sparkSession
    staged = f"{path}/staged/{uuid.uuid4().hex}"
    name = F.col(key).cast("string")
    rows = _in_bucket(outputs, key)
    rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{staged}/data")
    new = spark.read.schema(rows.schema).parquet(f"{staged}/data").groupBy(name.alias("_key")).agg(F.count("*").alias("n_rows"))
    at_hand = fingerprints.select(name.alias("_key"), "fingerprint", "params").join(new, "_key", "full")
    _in_bucket(at_hand, "_key").write.parquet(f"{staged}/keys")
    at_hand = spark.read.parquet(f"{staged}/keys")
    touched = sorted(r._bucket for r in at_hand.select("_bucket").distinct().collect())
    fs, stored = _files(spark, f"{path}/data/_bucket=*")
    others = lambda df: df.where(F.col("_bucket").isin(touched)).join(at_hand.select("_key"), name.eqNullSafe(F.col("_key")), "left_anti")
    if fs.globStatus(stored):
        others(spark.read.option("mergeSchema", True).parquet(f"{path}/data")).hint("rebalance", "_bucket").write.mode("append").partitionBy("_bucket").parquet(f"{staged}/data")
    done = at_hand.where("fingerprint IS NOT NULL").select(F.col("_key").alias(key), "fingerprint", "params", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), "_bucket")
    kept = others(_in_bucket(read_sidecars(spark, path, key), key))
    done.unionByName(kept).repartition("_bucket").write.partitionBy("_bucket").json(f"{staged}/sidecars")
    for part in ("data", "sidecars"):
        fs.mkdirs(_files(spark, f"{path}/{part}")[1])
    for bucket in touched:
        _swap_bucket(spark, staged, path, bucket)
    fs.delete(_files(spark, f"{path}/staged")[1], True)


def read_sidecars(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``key, fingerprint, params, n_rows`` of what was written; no rows before the first time."""
    schema = f"{key} string, fingerprint string, params string, n_rows long"
    fs, at = _files(spark, f"{path}/sidecars")
    if not fs.exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{path}/sidecars").select(key, "fingerprint", "params", "n_rows")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """CSV in fixed column order, by split (train, val, test) and id. A manifest has a row per dyad."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    columns = [c for c in MANIFEST_COLUMNS if c in manifest.columns]
    manifest.orderBy(order, "interaction_id").select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_packed(lines: DataFrame, path: str) -> None:
    """Lines of documents (columns of ``PACKED``) in few files; readers take them as ``packed``."""
    lines.select(*[F.col(c.name).cast(c.dataType) for c in T.StructType.fromDDL(PACKED)]).write.mode("overwrite").parquet(path)


def pack_files(spark: SparkSession, folders: list[str], path: str, glob: str = "*", wholetext: bool = False) -> None:
    """Pack the text files under these folders, a folder after another: the driver lists one at a time."""
    for n, folder in enumerate(folders):
        lines = document_lines(spark, folder, recursiveFileLookup=True, pathGlobFilter=glob, wholetext=wholetext)
        lines.hint("rebalance").write.mode("append" if n else "overwrite").parquet(path)


def write_run_manifest(config: dict[str, str], counts: DataFrame, dyads: DataFrame, path: str, class_names: dict[int, str] | None = None, lexicon: tuple[str, ...] = ()) -> None:
    """Provenance as JSON: configuration, counts per tau and split, flags per dyad, each in a folder, and
    all of it as one ``document``.

    The lines of its files, one after another, are the document: configuration, class names and
    lexicon, the counts, and the dyads, an entry a line, so that dyads of any number are written by
    many tasks. ``read_run_manifest`` reads it back.
    """
    spark = counts.sparkSession
    spark.createDataFrame([(config,)], "config map<string,string>").write.mode("overwrite").json(f"{path}/config")
    counts.write.mode("overwrite").json(f"{path}/counts")
    dyads.write.mode("overwrite").json(f"{path}/dyads")
    head = {"config": config, "class_names": {str(k): v for k, v in sorted((class_names or {}).items())}, "lexicon": list(lexicon)}
    first = spark.createDataFrame([(0, "", "{\n" + ",\n".join(f"{json.dumps(k)}: {json.dumps(v, sort_keys=True)}" for k, v in head.items()) + ",")], "part int, key string, value string")

    def entries(df: DataFrame, part: int, name: str, keys: list[str]) -> DataFrame:
        rows = df.select(F.lit(part).alias("part"), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys if k in df.columns]).alias("key"), F.concat(F.lit("  "), F.to_json(F.struct(*df.columns)), F.lit(",")).alias("value"))
        ends = spark.createDataFrame([(part - 1, "", f'"{name}": ['), (part + 1, "", "  null],")], rows.schema)
        return rows.unionByName(ends)

    parts = first.unionByName(entries(counts, 2, "counts", ["tau_ms", "split"])).unionByName(entries(dyads, 5, "dyads", ["interaction_id"]))
    last = spark.createDataFrame([(9, "", '"format": 1\n}')], first.schema)
    parts.unionByName(last).repartitionByRange(LABEL_FILES, "part", "key").sortWithinPartitions("part", "key").select("value").write.mode("overwrite").text(f"{path}/document")


def read_run_manifest(spark: SparkSession, path: str, counts: str, dyads: str) -> tuple[dict, DataFrame, DataFrame]:
    """The document's head, and its counts and dyads as rows of the given schemas."""
    lines = spark.read.text(f"{path}/document")
    head = "\n".join(r.value for r in lines.where(F.col("value").rlike('^("(config|class_names|lexicon)": )')).collect())
    entry = lines.where(F.col("value").startswith("  {")).select(F.regexp_replace("value", r",\s*$", "").alias("value"))
    rows = lambda ddl, has: entry.where(F.get_json_object("value", f"$.{has}").isNotNull()).select(F.from_json("value", ddl).alias("x")).select("x.*")
    return json.loads("{" + head.rstrip(", \n") + "}"), rows(counts, "tau_ms"), rows(dyads, "interaction_id")


def write_results_incremental(results: DataFrame, path: str) -> None:
    """Results by experiment and tau; a rerun replaces its own partitions only."""
    _replace(results, path, ["experiment", "tau_ms"])


def write_summary_csvs(frames: dict[str, DataFrame], path: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_wcc(wcc: DataFrame, path: str, key: str = "interaction_id") -> None:
    _replace(wcc, path, [key])
