"""Readers of manifests, intervals, transcripts, labels, annotations, lookups and feature files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.scalars import asset_url, interaction_id, participant_id, prompt_hash, session, try_float, vendor

# The columns of a manifest file, in order.
MANIFEST_COLUMNS = ["split", "seamless_split", "interaction_id", "vendor_id", "session_id", "prompt_hash", "interaction_type", "label", "annotation_coverage", "relationship", "relationship_detail", "file_id_a", "file_id_b", "participant_a", "participant_b", "audio_url_a", "audio_url_b", "video_url_a", "video_url_b", "vad_url_a", "vad_url_b"]


def read_manifest(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV of strings; a missing required column, or no row, is an error."""
    df = spark.read.option("header", True).csv(path)
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"{path} lacks the columns {absent}")
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


#: Where a recording's id stands in the path of its files.
VAD_FILE = r"vad_([^/]*)\.jsonl?$"
TRANSCRIPT_FILE = r"transcript_([^/]*)\.jsonl?$"


def _file_id(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


#: A packed table holds the lines of many documents, so that there are few files however many
#: documents: the path of a document, the place of a line in it, and the line (or the whole text).
PACKED = "path string, block long, line long, value string"


def document_lines(spark: SparkSession, path: str, packed: bool = False, **options) -> DataFrame:
    """The columns of ``PACKED`` of text files, or of a packed table (``sinks.write_packed``, ``sinks.pack_files``)."""
    if packed:
        return spark.read.schema(PACKED).parquet(path)
    return spark.read.text(path, **options).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def _packed_json(spark: SparkSession, path: str, ddl: str, mode: str = "PERMISSIVE") -> DataFrame:
    """``path, block, line, entry`` and the columns of ``ddl`` of a packed table of JSON, as Spark's reader has
    them of files: a row for each object or entry of an array, nulls where a text is malformed."""
    schema = T.ArrayType(T.StructType.fromDDL(ddl))
    held = F.from_json("value", schema, {"mode": mode})
    rows = F.when(held.isNull(), F.array(F.lit(None).cast(schema.elementType))).otherwise(held)
    return document_lines(spark, path, True).where(F.trim("value") != "").select("path", "block", "line", F.posexplode(rows).alias("entry", "x")).select("path", "block", "line", "entry", "x.*")


def read_intervals(spark: SparkSession, path: str, pattern: str = VAD_FILE, packed: bool = False) -> DataFrame:
    """``file_id, seg_idx, start_s, end_s`` from JSON lines, by start; a bad line is an error. With
    ``packed`` the lines are those of a packed table."""
    ddl = "start double, end double"
    if packed:
        rows = _packed_json(spark, path, ddl, "FAILFAST")
    else:
        rows = spark.read.schema(ddl).option("mode", "FAILFAST").json(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.lit(0).alias("entry"), "start", "end")
    named = rows.select(F.regexp_extract("path", pattern, 1).alias("file_id"), "block", "line", "entry", F.col("start").alias("start_s"), F.col("end").alias("end_s"))
    w = Window.partitionBy("file_id").orderBy("start_s", "block", "line", "entry")
    return named.withColumn("seg_idx", F.row_number().over(w)).select("file_id", "seg_idx", "start_s", "end_s")


def read_transcripts(spark: SparkSession, path: str, pattern: str = TRANSCRIPT_FILE, packed: bool = False) -> DataFrame:
    """``file_id, words`` from JSON lines; malformed lines are skipped. Words are maps, so that an
    absent key can be told from a null value. With ``packed`` the lines are those of a packed table."""
    schema = T.StructType.fromDDL("words array<map<string,string>>")
    rows = document_lines(spark, path, packed).select(F.regexp_extract("path", pattern, 1).alias("file_id"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j"))
    return rows.where(F.col("j.words").isNotNull()).select("file_id", F.col("j.words").alias("words"))


def flatten_words(transcripts: DataFrame) -> DataFrame:
    """``file_id, word, start_s, end_s`` of words that have both keys and a start."""
    w = transcripts.select("file_id", F.explode("words").alias("w"))
    ok = F.map_contains_key("w", "start") & F.map_contains_key("w", "end") & F.col("w")["start"].isNotNull()
    return w.where(ok).select("file_id", F.col("w")["word"].alias("word"), F.col("w")["start"].cast("double").alias("start_s"), F.col("w")["end"].cast("double").alias("end_s"))


#: An entry of a label object between two cuts: what stands before a key, the key, the value.
LABEL_ENTRY = r'^(?:\s*\{?\s*")?((?:[^"\\]|\\.)*)"\s*:\s*"?([^"{}\[\],]*?)"?[\s,}]*$'
EMPTY_OBJECT = r"^[\s{},]*$"


def _checked(key: Column, raw: Column) -> Column:
    label = F.trim(raw).try_cast("int")
    return F.when(label.between(0, 5), label).otherwise(F.raise_error(F.concat(F.lit("bad label of "), key)).cast("int"))


def _object_entries(rows: DataFrame) -> DataFrame:
    """``sample_key, raw`` of texts that are one JSON object each; any other text is an error."""
    held = F.from_json("value", "map<string,string>")
    return rows.select(F.explode(F.when(held.isNull(), F.raise_error(F.lit("labels must be a JSON object")).cast("map<string,string>")).otherwise(held)).alias("sample_key", "raw"))


def _entry_separator(spark: SparkSession, path: str) -> str:
    """What stands between two entries, from the first few of them: a comma, white space, a quote."""
    some = spark.read.option("lineSep", ",").text(path).limit(100).select(F.regexp_extract("value", r'^(\s*)"', 1).alias("space"), F.col("value").rlike(r'^\s*"').alias("entry"))
    found = some.where("entry").groupBy("space").count().orderBy(F.desc("count"), "space").limit(1).collect()
    return "," + (found[0].space if found else "") + '"'


def read_labels(spark: SparkSession, path: str, tau_ms: int, lines: bool = False) -> DataFrame:
    """``sample_key, tau_ms, label`` from files of one JSON object; a label outside 0..5 is an error.

    A file is cut between entries, not at line ends, so an object of any size is read by many
    tasks, on one line or on many; so is an object that is written in several files. The cut is a
    comma, the white space that this writer uses, and a quote, which no key can hold inside, as
    its quotes are escaped. Files in which a piece is no entry (keys that end like a cut, mixed white
    space) are read in one piece. With ``lines`` each line is an object.
    """
    if lines:
        entries = _object_entries(spark.read.text(path))
    else:
        name = F.col("_metadata.file_path")
        pieces = spark.read.option("lineSep", _entry_separator(spark, path)).text(path).select(name.alias("_file"), "value").where(~F.col("value").rlike(EMPTY_OBJECT))
        part = lambda i: F.regexp_extract("value", LABEL_ENTRY, i)
        odd = [r._file for r in pieces.where(~F.col("value").rlike(LABEL_ENTRY)).select("_file").distinct().collect()]
        key = F.get(F.from_json(F.concat(F.lit('["'), part(1), F.lit('"]')), "array<string>"), 0)
        entries = pieces.where(~F.col("_file").isin(odd)).select(key.alias("sample_key"), part(2).alias("raw"))
        if odd:
            entries = entries.unionByName(_object_entries(spark.read.text(odd, wholetext=True)))
    return entries.select("sample_key", F.lit(tau_ms).alias("tau_ms"), _checked(F.col("sample_key"), F.col("raw")).alias("label"))


ANNOTATION_FILE = r"3P-([A-Z]+)_(.+)_([^_/]+)\.json$"
#: Start, end and id of a window's feature file.
FEATURE_FILE = r"(\d+\.\d+)-(\d+\.\d+)_([^/]+?)\.[A-Za-z0-9]+$"


def read_annotations(spark: SparkSession, path: str, pattern: str = ANNOTATION_FILE) -> DataFrame:
    """``kind, interaction_id, participant_id, annotation, start_ts, end_ts``; ids come from the file name."""
    name = F.col("_metadata.file_path")
    rows = spark.read.schema("annotation string, start_ts long, end_ts long").json(path)
    return rows.select(F.regexp_extract(name, pattern, 1).alias("kind"), F.regexp_extract(name, pattern, 2).alias("interaction_id"), F.regexp_extract(name, pattern, 3).alias("participant_id"), "annotation", "start_ts", "end_ts")


def read_relationships(spark: SparkSession, path: str) -> DataFrame:
    """``vendor_id, session_id, relationship, relationship_detail`` of multi-line JSON documents."""
    return spark.read.schema("vendor_id string, session_id string, relationship string, relationship_detail string").option("multiLine", True).json(path)


def interactions_from_filelist(filelist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dyads of exactly two files with one label and one split, and the others with a reason."""
    ids = filelist.withColumn("interaction_id", interaction_id("file_id")).withColumn("participant", participant_id("file_id"))
    g = ids.groupBy("interaction_id").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"), F.countDistinct("split").alias("splits"), F.min("file_id").alias("file_id_a"), F.max("file_id").alias("file_id_b"), F.min("label").alias("label"), F.min("split").alias("split"))
    reason = F.when(F.col("n") != 2, "file_count").when(F.col("labels") != 1, "labels").when(F.col("splits") != 1, "splits")
    marked = g.withColumn("reason", reason)
    good = marked.where("reason IS NULL").select("interaction_id", "label", "split", "file_id_a", "file_id_b", participant_id("file_id_a").alias("participant_a"), participant_id("file_id_b").alias("participant_b"))
    return good, marked.where("reason IS NOT NULL").select("interaction_id", "reason")


#: The folder of a dyad in the paths of its documents.
DYAD_FOLDER = r"/([^/]+)/interaction/[^/]+$"


def read_interactions(spark: SparkSession, filelist: str, metadata: str, relationships: str, pattern: str = DYAD_FOLDER, lines: bool = False, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Dyads composed from their JSON documents, and the dyads with a fault and its reason.

    ``filelist``: entries of file_id, label and split; ``metadata``: interaction_type;
    ``relationships``: relationship and its detail. Documents meet by the folder that ``pattern``
    finds in their paths (with ``lines`` they are JSON lines), so a dyad of which a document is absent is a fault as well. Columns are
    those of a manifest, without the split, the split of the source being ``seamless_split``. With ``packed`` the
    three paths are packed tables of documents or of their lines.
    """

    def read(path: str, ddl: str) -> DataFrame:
        rows = _packed_json(spark, path, ddl) if packed else spark.read.schema(ddl).option("multiLine", not lines).json(path)
        return rows.select(*T.StructType.fromDDL(ddl).names, F.regexp_extract("path" if packed else F.col("_metadata.file_path"), pattern, 1).alias("_dir"))

    entries = read(filelist, "file_id string, label string, split string")
    pid = participant_id("file_id")
    entry = F.struct(pid.alias("pid"), "file_id")
    g = entries.groupBy("_dir").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"), F.countDistinct("split").alias("splits"), F.min("label").alias("label"), F.min("split").alias("seamless_split"), F.min(entry).alias("_a"), F.max(entry).alias("_b"))
    meta = read(metadata, "interaction_type string").select("_dir", "interaction_type", F.lit(True).alias("_meta"))
    rel = read(relationships, "relationship string, relationship_detail string").select("_dir", "relationship", "relationship_detail", F.lit(True).alias("_rel"))
    reason = F.when(F.col("n") != 2, "file_count").when(F.col("labels") != 1, "labels").when(F.col("splits") != 1, "splits").when(F.col("_meta").isNull(), "no_metadata").when(F.col("_rel").isNull(), "no_relationship")
    marked = g.join(meta, "_dir", "left").join(rel, "_dir", "left").withColumn("reason", reason)
    ids = marked.where("reason IS NULL").withColumn("interaction_id", interaction_id(F.col("_a.file_id")))
    for x in "ab":
        ids = ids.withColumn(f"file_id_{x}", F.col(f"_{x}.file_id")).withColumn(f"participant_{x}", F.col(f"_{x}.pid"))
    urls = [asset_url("label", "seamless_split", kind, f"file_id_{x}", ext).alias(f"{kind}_url_{x}") for kind, ext in (("audio", "wav"), ("video", "mp4"), ("vad", "jsonl")) for x in "ab"]
    derived = [vendor("interaction_id").alias("vendor_id"), session("interaction_id").alias("session_id"), prompt_hash("interaction_id").alias("prompt_hash")]
    good = ids.select("*", *urls, *derived)
    return good.select(*[c for c in MANIFEST_COLUMNS if c in good.columns]), marked.where("reason IS NOT NULL").select(F.col("_dir").alias("folder"), "reason")


def read_lookup(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """A lookup CSV, of which the last row of a key wins (files in order of their names)."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    df = spark.read.option("header", True).csv(path).withColumn("_line", place)
    rest = [c for c in df.columns if c not in (*keys, "_line")]
    last = F.max(F.struct("_line", *rest)).alias("x")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def index_feature_files(spark: SparkSession, path: str, glob: str = "*", pattern: str = FEATURE_FILE) -> DataFrame:
    """``path, bytes, start_s, end_s, file_id`` of files named ``start-end_id.ext``; others are dropped.

    Only names and lengths are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("bytes"))
    part = lambda i: F.regexp_extract("path", pattern, i)
    return files.where(F.col("path").rlike(pattern)).select("path", "bytes", part(1).cast("double").alias("start_s"), part(2).cast("double").alias("end_s"), part(3).alias("file_id"))


def json_matrix(value: Column, name: Column) -> Column:
    """The matrix in a JSON text; a text without one is an error that names it."""
    matrix = "array<array<double>>"
    held = F.from_json(value, f"features {matrix}, embeddings {matrix}")
    found = F.when(F.trim(value).startswith("["), F.from_json(value, matrix)).otherwise(F.coalesce(held["features"], held["embeddings"]))
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("no features in "), name)).cast(matrix)).otherwise(found)


def read_json_features(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """``path, matrix`` of JSON files: a bare array of rows, or an object with features or embeddings.

    With ``packed`` they are the whole texts of a packed table.
    """
    rows = document_lines(spark, path, packed, wholetext=True)
    return rows.select("path", json_matrix(F.col("value"), F.col("path")).alias("matrix"))


def read_coordination(spark: SparkSession, path: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Coordination rows of a CSV by key, the last row of a key winning; a missing column is an error."""
    df = read_lookup(spark, path, keys)
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"{path} lacks the columns {absent}")
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])


def read_results(spark: SparkSession, path: str, texts: tuple[str, ...] = ("experiment", "experiment_name", "ablation", "arch")) -> DataFrame:
    """A result CSV; columns other than ``texts`` are numbers, or null where they are none."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.col(c) if c in texts else try_float(c).alias(c) for c in df.columns])


def read_poc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).drop("split").withColumn("annotation_coverage", F.lit("none"))
