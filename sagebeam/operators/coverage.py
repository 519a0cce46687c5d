"""Coverage roll-ups over a dimension, weakness scores and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent_capped(count: Column, target: Column) -> Column:
    """Whole percent of a target, at most 100; 0 without a target."""
    return F.when(F.coalesce(target, F.lit(0)) > 0, F.least(F.lit(100.0), F.floor(100 * count / target + 0.5))).otherwise(F.lit(0.0)).cast("long")


def percent_exact(count: Column, target: Column) -> Column:
    """Percent of a target to one decimal; null without a target."""
    return F.when(target > 0, F.floor(1000 * count / target + 0.5) / 10)


def roll_up(dimension: DataFrame, rows: DataFrame, key: str, counters: dict[str, Column]) -> DataFrame:
    """Every row of ``dimension`` with how many ``rows`` of its key meet each condition, 0 where there are none."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in counters.items()])
    names = ["n", *counters]
    return dimension.join(counts, key, "left").select(*dimension.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def weakness(sources: Column, indicators: Column, exclusions: Column, look_alikes: Column, confirmation: Column, has_visual: Column, reviewed: Column) -> Column:
    """How far a record is from complete, from counts of its parts."""
    rules = ((sources < 1, 8), (indicators < 2, 5), (exclusions < 2, 4), (look_alikes < 2, 4), (confirmation < 2, 5), (~has_visual, 3), (~reviewed, 2))
    return sum((F.when(rule, points).otherwise(0) for rule, points in rules), F.lit(0))


def audit_counters(approved: Column, resolved: Column, sources: Column, indicators: Column, exclusions: Column, look_alikes: Column, confirmation: Column) -> dict[str, Column]:
    """The conditional counts of the coverage audit, from a record's number of approved and of resolved pictures and of its parts."""
    return {
        "with_visual": resolved > 0, "without_approved": approved == 0, "without_visual": resolved == 0, "without_sources": sources == 0, "weak_indicators": indicators < 2,
        "weak_exclusions": exclusions < 2, "weak_look_alikes": look_alikes < 2, "weak_confirmation": confirmation < 2}


def audit(dimension: DataFrame, rows: DataFrame, key: str, approved: str, target: str, counters: dict[str, Column]) -> DataFrame:
    """Every row of ``dimension`` (key and target) with records, approved pictures, the conditional counts and the percent of its target."""
    counts = rows.groupBy(key).agg(F.count("*").alias("records"), F.sum(approved).alias("approved_images"), *[F.count_if(c).alias(n) for n, c in counters.items()])
    names = ["records", "approved_images", *counters]
    out = dimension.join(counts, key, "left").select(*dimension.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])
    return out.withColumn("percent", percent_exact(F.col("approved_images"), F.col(target)))


def totals(rows: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """One row of conditional counts."""
    return rows.agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in counters.items()])


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) of each label; macro values are averages over these rows."""
    table = confusion(rows, label, predicted)
    hit = table.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    said = table.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    precision, recall = F.when(F.col("said") > 0, F.col("hits") / F.col("said")).otherwise(0.0), F.col("hits") / F.col("support")
    out = hit.join(said, "label", "left").withColumn("said", F.coalesce("said", F.lit(0))).withColumn("precision", precision).withColumn("recall", recall)
    return out.select("label", "support", "precision", "recall", F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """One row: the expected calibration error, the mean gap between confidence and share of correct rows over equal bins, by their rows."""
    numbered = rows.withColumn("_bin", F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)))
    per = numbered.groupBy("_bin").agg(F.count("*").alias("n"), F.abs(F.avg(confidence) - F.avg(F.col(correct).cast("double"))).alias("gap"))
    return per.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def selective_accuracy(rows: DataFrame, confidence: str, correct: str, least: float) -> DataFrame:
    """One row: the share of rows with at least this confidence, and how many of them are correct."""
    kept = F.col(confidence) >= least
    return rows.agg(F.avg(kept.cast("double")).alias("covered"), F.avg(F.when(kept, F.col(correct).cast("double"))).alias("accuracy"))


def top_recall(rows: DataFrame, label: str, ranked: str, k: int = 3) -> DataFrame:
    """(label, support, recall): how often a label is among the first k of an array of predictions."""
    hit = F.array_contains(F.slice(ranked, 1, k), F.col(label))
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("support"), F.avg(hit.cast("double")).alias("recall"))


def macro(metrics: DataFrame) -> DataFrame:
    """One row: macro F1 and balanced accuracy of ``class_metrics``."""
    return metrics.agg(F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy"))
