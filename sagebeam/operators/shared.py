"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, gone when the driver ends; a local session without such a folder gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sagebeam-")
    if not _made:
        atexit.register(_sweep, spark)
    _made.append(f"{found.rstrip('/')}/sagebeam-{name}-{uuid.uuid4().hex[:10]}")
    return _made[-1]


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


def _sweep(spark: SparkSession) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _made:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the JVM may be gone at exit; the folder then stays for the cluster's own cleaning
        return


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written as a table in the shared folder and read again: lineage ends here."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
