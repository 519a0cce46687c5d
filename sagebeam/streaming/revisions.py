"""An append-only store of analyses, fed by a stream: revisions are new rows, and nothing that is there is overwritten."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebeam.operators.revisions import lineage
from sagebeam.operators.shared import stored

# Why a row is not taken.
EXISTS, REVIEWED, UNKNOWN, TWICE = "analysis exists", "reviewed analysis may not be overwritten", "superseded analysis is not there", "different analyses of one id in a batch"


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def kept(spark: SparkSession, path: str, schema: str, what: str = "analyses") -> DataFrame:
    """The rows of a store, or those that it ``refused`` with the reason; ``batch`` is the micro-batch that brought them."""
    whole = f"{schema}, {'reason string, ' if what == 'refused' else ''}batch long"
    place = f"{path}/{what}"
    return spark.read.schema(whole).parquet(place) if _there(spark, place) else spark.createDataFrame([], whole)


def appender(path: str, schema: str, own: str = "analysis_id", supersedes: str = "supersedes_analysis_id", reviewed: Callable[[SparkSession], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that appends analyses to the store at ``path``, a folder that all executors share.

    A row whose id is new is appended if what it supersedes is null, in the store,
    or appended with it.  A row that is there with equal content is a resend and
    changes nothing; with other content it is refused, by another reason if
    ``reviewed`` (ids of reviewed analyses, asked for each batch) has the id.  Of
    unlike rows of one id in a batch none is taken, of equal ones one.  Rows that
    supersede each other in a circle, or something refused, are refused.  Rows
    without an id are refused as unknown.

    A micro-batch writes into a partition of its own and replaces only that, so a
    batch that is run again after a failure leaves what its first run would have.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = [f.name for f in spark.createDataFrame([], schema).schema]
        content = F.xxhash64(*columns)
        before = kept(spark, path, schema).where(F.col("batch") != number)
        rows = stored(batch.select(*columns).distinct().withColumn("_content", content), "revisions-batch")
        there = before.select(F.col(own).alias("_id"), content.alias("_old"))
        marks = there if reviewed is None else there.join(reviewed(spark).toDF("_id").distinct().withColumn("_reviewed", F.lit(True)), "_id", "left")
        marks = marks if reviewed else marks.withColumn("_reviewed", F.lit(None).cast("boolean"))
        often = rows.groupBy(F.col(own).alias("_many")).count().where("count > 1").select("_many")
        met = rows.join(marks, F.col(own) == F.col("_id"), "left").join(often, F.col(own).eqNullSafe(F.col("_many")), "left")
        reason = (
            F.when(F.col(own).isNull(), UNKNOWN).when(F.col("_old") == F.col("_content"), "").when(F.col("_old").isNotNull(), F.when(F.col("_reviewed"), REVIEWED).otherwise(EXISTS))
            .when(F.col("_many").isNotNull(), TWICE))
        judged = stored(met.select(*columns, reason.alias("reason")), "revisions-judged")
        fresh = judged.where("reason is null").drop("reason")
        # What a chain within the batch begins with must be free or stand on something that is there.
        line = lineage(fresh, own, supersedes, circles=True)
        base = fresh.select(F.col(own).alias("root"), F.col(supersedes).alias("under")).join(there.select(F.col("_id").alias("under"), F.lit(True).alias("stands")), "under", "left")
        sound = line.join(base, "root").where("under is null or stands").select(F.col("id").alias("_sound"))
        placed = stored(fresh.join(sound, F.col(own) == F.col("_sound"), "left"), "revisions-placed")
        refused = placed.where("_sound is null").select(*columns, F.lit(UNKNOWN).alias("reason")).unionByName(judged.where("reason <> ''"))
        placed.where("_sound is not null").select(*columns).write.mode("overwrite").parquet(f"{path}/analyses/batch={number}")
        refused.write.mode("overwrite").parquet(f"{path}/refused/batch={number}")

    return append
