"""Shared plumbing of the operators: tables in the shared folder, connected components, safe columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = uuid.uuid4().hex[:12]
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set a local session makes one of its own; on a cluster, whose
    executors would not see it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sagebeam-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it goes when the driver ends or ``discard`` is called."""
    path = f"{shared_dir(spark)}/sagebeam-{_RUN}/{name}-{uuid.uuid4().hex[:10]}"
    if not _made:
        atexit.register(_sweep, spark)
    _made.add(path)
    return path


#: Rows and bytes of an Arrow batch: texts may be long, and a batch is in memory as a whole.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most ``BATCH_ROWS`` rows that end once ``BATCH_BYTES`` are in them."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
    return spark


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no pending plan reads any more."""
    for path in paths:
        fs, p = _filesystem(spark, path)
        fs.delete(p, True)
        _made.discard(path)


def _sweep(spark: SparkSession) -> None:
    try:
        discard(spark, *list(_made))
    except Exception:  # the JVM may be gone at exit; the folder then stays for the cluster's own cleaning
        return


#: Files of a narrow table for each task that runs at once.
NARROW_FILES = 4


def narrow(df: DataFrame) -> DataFrame:
    """``df``, of a few numbers a row, in at most ``NARROW_FILES`` partitions for each task that runs at once.

    For what is written out: each file costs calls, and where files are local, Hadoop starts processes for it.
    """
    return df.coalesce(NARROW_FILES * df.sparkSession.sparkContext.defaultParallelism)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder and read again: lineage ends here, and a lost executor costs no rework."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def fresh(df: DataFrame, wanted: str) -> str:
    """``wanted``, or that name with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


#: Share of all edges beyond which a node is hot.
HOT = 1e-4


def components(edges: DataFrame, name: str = "components") -> tuple[DataFrame, list[str]]:
    """Connected components of the undirected ``edges(a long, b long)``: (node, root), root the smallest node reachable.

    Minimum labels spread along edges and then jump to the label of their label,
    so that rounds grow with the logarithm of the diameter.  Every round is an
    aggregation with map-side combine and equi-joins on node keys; labels are
    written to the shared folder between rounds and only one number a round reaches
    the driver.  Nodes with more than ``HOT`` of all edges, which are fewer than its
    inverse, tell their labels by broadcast, so that no star is one task.  Also
    returns the paths that the result reads.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both, edge_path = stored(narrow(both.where("a <> b")), f"{name}-edges")
    labels, path = stored(narrow(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"), F.count("*").alias("edges"))), f"{name}-labels")
    total, most = labels.agg(F.sum("edges"), F.max("edges")).first()
    paths, hot = [edge_path], None
    if total and most > (least := max(1000, int(total * HOT))):
        hot, hot_path = stored(narrow(labels.where(F.col("edges") > least).select("node", F.lit(True).alias("hot"))), f"{name}-hot")
        marked = both.join(F.broadcast(hot.withColumnRenamed("node", "a")), "a", "left")
        paths.append(hot_path)
    labels, moved = labels.select("node", "root"), total
    while moved:
        at_a = labels.withColumnRenamed("node", "a")
        if hot is None:
            said = both.join(at_a, "a")
        else:
            told = F.broadcast(labels.join(F.broadcast(hot), "node").select(F.col("node").alias("a"), "root"))
            said = marked.where("hot").join(told, "a").unionByName(marked.where("hot is null").join(at_a, "a"))
        said = said.select(F.col("b").alias("node"), "root", F.lit(None).cast("long").alias("was"))
        near = said.unionByName(labels.withColumn("was", F.col("root"))).groupBy("node").agg(F.min("root").alias("root"), F.max("was").alias("was"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("over"))
        # The label of a label is a node of the same component, so following it is always allowed.
        jumped = near.join(up, "root", "left").select("node", F.least("root", F.coalesce("over", "root")).alias("root"), "was")
        newer, newer_path = stored(narrow(jumped.select("node", "root", (F.col("root") != F.col("was")).alias("moved"))), f"{name}-labels")
        moved = newer.where("moved").limit(1).count()
        discard(spark, path)
        labels, path = newer.select("node", "root"), newer_path
    discard(spark, *paths)
    return labels, [path]


#: Rows of some hundred bytes at most that are broadcast: below 100 MB.  Rows of a key below which it is not hot.
BROADCAST_ROWS, HOT_ROWS = 500_000, 1000


def meet(rows: DataFrame, other: DataFrame, key: str, n_other: int, name: str) -> DataFrame:
    """``rows`` joined with ``other``, whose ``key`` is unique: by broadcast where it is small, else by shuffle but for the hot keys of ``rows``.

    Hot keys have more than ``HOT`` of all rows each, so they are fewer than its inverse and their entries can be broadcast.
    """
    if n_other <= BROADCAST_ROWS:
        return rows.join(F.broadcast(other), key)
    rows, _ = stored(rows, name)
    least = max(HOT_ROWS, int(rows.count() * HOT))
    hot, _ = stored(rows.groupBy(key).count().where(F.col("count") > least).select(key, F.lit(True).alias("_hot")), f"{name}-hot")
    marked = rows.join(F.broadcast(hot), key, "left")
    few = other.join(F.broadcast(hot.select(key)), key)
    return marked.where("_hot").drop("_hot").join(F.broadcast(few), key).unionByName(marked.where("_hot is null").drop("_hot").join(other.hint("shuffle_hash"), key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as run at once, where their files make fewer splits; inputs of more splits stay as they are.

    For work on whole texts in Python, which costs far more than moving them.
    """
    at_once = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(at_once) if rows.rdd.getNumPartitions() < at_once else rows


Query = Callable[[SparkSession, str], DataFrame]
