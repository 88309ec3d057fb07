"""Connected components as a loop of joins and minimum aggregates."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests) gets a temporary folder; on a cluster it is an
    error, because executors share no local disk.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        props = spark.sparkContext._jvm.java.lang.System
        folder = props.getProperty("parley.checkpoint.dir")
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="parley-checkpoint-")
            props.setProperty("parley.checkpoint.dir", folder)
    return folder


#: Lists of paths that ``scratch`` blocks at hand have seen written.
_SEEN: list[list[str]] = []


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what is above, and a step that
    is read twice runs once. The files stay until ``discard`` or the ``scratch`` block around them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/parley-{uuid.uuid4().hex}"
    for seen in _SEEN:
        seen.append(path)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for these; nothing that is still to be computed may read them."""
    for df in tables:
        _delete(df.sparkSession, df._written_to)


@contextmanager
def scratch(spark: SparkSession):
    """A block whose written tables are deleted at its end, but for those given to the function it yields."""
    seen: list[str] = []
    _SEEN.append(seen)
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        out = written(df)
        kept.add(out._written_to)
        return out

    try:
        yield keep
    finally:
        # nested blocks may hold equal lists, so the list itself is taken out
        _SEEN[:] = [x for x in _SEEN if x is not seen]
        for path in seen:
            if path not in kept:
                _delete(spark, path)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for every end of an edge; the component is its smallest node.

    Each round hooks every node and its parent to the smallest grandparent among the neighbours,
    then halves the paths, so rounds grow with the logarithm of the longest path. A component in
    which all nodes and neighbours have one grandparent is finished and leaves, and edges are cut
    down whenever half of the nodes have left. Aggregates combine before the shuffle, so a hub costs one
    row per task. The tables of a round are deleted after it. Edges to itself keep a node; null ends
    are dropped; no edges give no rows.
    """
    raw = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("u"), F.col(dst).alias("v"))
    both = written(raw.unionByName(raw.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    parents = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("f")))
    at_hand = parents.count()
    finished = None
    while True:
        up = parents.select(F.col("u").alias("p"), F.col("f").alias("g"))
        grand = written(parents.join(up, F.col("f") == F.col("p")).select("u", "f", "g"))
        around = both.join(grand.select(F.col("u").alias("v"), F.col("g")), "v").groupBy("u").agg(F.min("g").alias("m"), F.max("g").alias("most"))
        moved = written(grand.join(around, "u"))
        closed = moved.groupBy("g").agg(F.bool_and((F.col("m") == F.col("g")) & (F.col("most") == F.col("g"))).alias("all")).where("all").select(F.col("g").alias("c"))
        done = written(moved.join(closed, F.col("g") == F.col("c"), "left_semi").select(F.col("u").alias("node"), F.col("g").alias("component")))
        left = moved.join(done.select("node"), F.col("u") == F.col("node"), "left_anti")
        options = left.select(F.explode(F.array(F.struct(F.col("f").alias("u"), F.col("m").alias("f")), F.struct(F.col("u"), F.least("m", "g", "f").alias("f")))).alias("x")).select("x.*")
        new = written(options.groupBy("u").agg(F.min("f").alias("f")))
        finished = done if finished is None else finished.unionByName(done)
        n = new.count()
        discard(grand, moved, parents)
        parents = new
        if not n:
            discard(both, new)
            return finished
        if 2 * n < at_hand:
            cut = written(both.join(new.select("u"), "u", "left_semi"))
            discard(both)
            both, at_hand = cut, n
