"""How queries read the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sagebeam.operators.shared import scratch  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
#: A query and its SQL, or None where SQL cannot express it.
Entry = tuple[Query, str | None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as run at once, where their files make fewer splits; inputs of more splits stay as they are.

    For work on whole texts, which costs far more than moving them.
    """
    at_once = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(at_once) if rows.rdd.getNumPartitions() < at_once else rows
