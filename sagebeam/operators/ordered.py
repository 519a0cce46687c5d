"""Order-dependent operators: prefix-sum admission, anchored rate limits, supersession."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagebeam.functions import text as T


def admit_by_budget(rows: DataFrame, key: str, order: list[str], size: str, positions: int = 8, most: float = 5_000_000, budget: float = 20_000_000, allowed: Column | None = None) -> DataFrame:
    """Rows within the first ``positions`` whose running size stays in the budget.

    Sizes of 0 or less and above ``most`` are skipped and cost nothing; the first row
    over the budget ends the run.  ``allowed`` is asked last, so rows that it refuses
    have used budget.
    """
    by = Window.partitionBy(key).orderBy(*order)
    first = rows.withColumn("position", F.row_number().over(by)).where(F.col("position") <= positions)
    sound = first.where((F.col(size) > 0) & (F.col(size) <= most))
    running = sound.withColumn("running", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("running") <= budget)
    return running if allowed is None else running.where(allowed)


def rate_limited(events: DataFrame, key: str, seconds: str, tie: str, window: int = 600, most: int = 12) -> DataFrame:
    """``events`` with window_start, count and accepted: windows begin at the first event after the last one's end.

    Refused events count too.  Where a window begins depends on all windows before
    it, so a key's events are gone through in order, by one task that keeps two
    numbers and streams the rest: no key has to fit in memory.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, start, n = object(), 0.0, 0
        for batch in batches:
            starts, counts = [], []
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if k != at or t - start >= window:
                    at, start, n = k, t, 0
                n += 1
                starts.append(start)
                counts.append(n)
            yield pa.record_batch([batch.column("k"), batch.column("tie"), pa.array(starts, pa.float64()), pa.array(counts, pa.int64())], names=["k", "tie", "start", "n"])

    dealt = events.select(F.col(key).alias("k"), F.col(seconds).cast("double").alias("t"), F.col(tie).cast("long").alias("tie")).repartition("k").sortWithinPartitions("k", "t", "tie")
    folded = dealt.mapInArrow(run, f"k {kind}, tie long, start double, n long")
    return folded.select(F.col("k").alias(key), F.col("tie").alias(tie), F.col("start").alias("window_start"), F.col("n").alias("count"), (F.col("n") <= most).alias("accepted"))


def current(rows: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Rows that no other row supersedes."""
    return rows.join(rows.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(key)), key, "left_anti")


def keep_slots(media: DataFrame, case: str, slot: str, order: str, several: dict[str, int]) -> DataFrame:
    """The latest row of each slot of a case, or as many as ``several`` says."""
    newest = F.row_number().over(Window.partitionBy(case, slot).orderBy(F.desc(order)))
    most = F.coalesce(*[F.when(F.col(slot) == s, F.lit(n)) for s, n in several.items()], F.lit(1))
    return media.withColumn("_newest", newest).where(F.col("_newest") <= most).drop("_newest")


def by_priority(rows: DataFrame, priority: str, name: str, tie: str) -> DataFrame:
    """``rows`` by priority and then name, a missing name as an empty one."""
    return rows.orderBy(priority, F.coalesce(F.col(name), F.lit("")), tie)


def sign_vocabulary(rows: DataFrame, signs: str) -> DataFrame:
    """(sign): the distinct entries of a column of arrays, in the order of their UTF-16 code units."""
    return rows.select(F.explode(signs).alias("sign")).distinct().orderBy(T.code_units(F.col("sign")))


def weakest(rows: DataFrame, score: str, name: str, k: int = 30) -> DataFrame:
    """The k rows of the largest score, equal ones by name in the order of the Unicode collation, names that it takes for equal by code points."""
    return rows.orderBy(F.desc(score), T.collated(F.col(name)), F.col(name)).limit(k)
