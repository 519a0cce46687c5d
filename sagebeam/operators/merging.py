"""Catalogue assembly: unions with an order, overlays, upserts, keyed merges with conflict detection, set differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_in_order(frames: list[DataFrame], position: str = "catalog_pos") -> DataFrame:
    """All rows of all frames; ``position`` orders them, first by frame and then by the frame's own ``position``."""
    placed = [f.withColumn("_frame", F.lit(i)).withColumn(position, F.struct(F.lit(i).alias("frame"), F.col(position).cast("long").alias("pos"))) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed).drop("_frame")


def unique_union(frames: list[DataFrame], key: str) -> DataFrame:
    """All rows of all frames; a key that stands twice stops the job."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    counted = rows.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*rows.columns)).alias("_row"))
    twice = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("stands twice: "), F.col(key).cast("string"))).cast("boolean"))
    return counted.where(twice.isNull()).select("_row.*")


def overlay(base: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """``base`` with the non-null fields of the patch of the same key laid over it; columns as in ``base``."""
    over = [c for c in patches.columns if c != key and c in base.columns]
    extra = [c for c in patches.columns if c != key and c not in base.columns]
    renamed = patches.select(F.col(key), *[F.col(c).alias(f"_over_{c}") for c in over], *extra)
    joined = base.join(renamed, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_over_{c}"), F.col(c)).alias(c) if c in over else F.col(c) for c in base.columns], *extra)


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last change by ``order``, else the base row; the base row's place stays."""
    both = base.withColumn("_turn", F.lit(0)).unionByName(changes.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    place = F.min(F.struct("_turn", order)).over(Window.partitionBy(key))[order]
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_turn"), F.desc(order)))
    return both.withColumn("_place", place).withColumn("_last", last).where("_last = 1").withColumn(order, F.col("_place")).drop("_turn", "_place", "_last")


def conflicts(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, field, versions) wherever a key has more than one distinct non-null value of a field."""
    counts = rows.groupBy(*key).agg(*[F.countDistinct(f).alias(f) for f in fields])
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    return counts.select(*key, F.expr(f"stack({len(fields)}, {pairs}) as (field, versions)")).where("versions > 1")


def merge_keyed(rows: DataFrame, key: str, order: str, latest: list[str], greatest: list[str] = (), lists: list[str] = (), check: list[str] = ()) -> DataFrame:
    """One row per key: the last non-null value by ``order`` of the ``latest`` fields, the largest of ``greatest``,
    and the distinct entries of ``lists`` in the order in which they first occur.

    A key with different non-null values of a ``check`` field stops the job; without
    any such field, later values win.
    """
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in latest]
    joined = [F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), F.col(f).alias("_list"))))["_list"])).alias(f) for f in lists]
    clash = [F.count_distinct(F.col(f)).alias(f"_n_{f}") for f in check]
    out = rows.groupBy(key).agg(*last, *[F.max(f).alias(f) for f in greatest], *joined, *clash)
    if check:
        told = F.concat_ws(", ", *[F.when(F.col(f"_n_{f}") > 1, F.lit(f)) for f in check])
        failed = F.when(told != "", F.raise_error(F.concat(F.lit("conflicting values of "), told, F.lit(" for "), F.col(key).cast("string"))).cast("boolean"))
        out = out.where(failed.isNull()).drop(*[f"_n_{f}" for f in check])
    return out


def repeated_unlike(rows: DataFrame, key: str) -> DataFrame:
    """Keys whose rows are not all alike in every other column."""
    whole = F.to_json(F.struct(*[c for c in rows.columns if c != key]), {"ignoreNullFields": "false"})
    return rows.select(key, whole.alias("_whole")).groupBy(key).agg(F.countDistinct("_whole").alias("versions")).where("versions > 1")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows that one side has more often than the other, with ``side``; empty where both are the same multiset."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def full_diff(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, state, changed): missing, unexpected, changed (with the names of the fields that differ) or same."""
    a, b = (f.select(key, F.struct(*fields).alias(side), F.lit(True).alias(f"in_{side}")) for f, side in ((expected, "a"), (actual, "b")))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "unexpected").when(F.size(changed) > 0, "changed").otherwise("same")
    return a.join(b, key, "full").select(key, state.alias("state"), F.when(F.col("in_a") & F.col("in_b"), changed).alias("changed"))


def deep_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, state) by whole records, nested fields and the order of lists among them: missing, unexpected, changed or same."""
    whole = lambda f, side: f.select(key, F.to_json(F.struct(*[c for c in f.columns if c != key]), {"ignoreNullFields": "false"}).alias(side))
    joined = whole(expected, "a").join(whole(actual, "b"), key, "full")
    return joined.select(key, F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("state"))


def shared_by_key(own: DataFrame, shared: DataFrame, group: str, key: Column, order: str) -> DataFrame:
    """Rows of ``own`` and then of ``shared``, one per group and key: the group's own row before a shared one."""
    both = own.withColumn("_shared", F.lit(False)).unionByName(shared.withColumn("_shared", F.lit(True)), allowMissingColumns=True).withColumn("_key", key)
    first = F.row_number().over(Window.partitionBy(group, "_key").orderBy("_shared", order))
    return both.withColumn("_first", first).where("_first = 1").drop("_first", "_key").withColumnRenamed("_shared", "is_shared")


def best_attempt(attempts: DataFrame, key: str, order: str, size: str | None = None) -> DataFrame:
    """Of a key's attempts the first valid one, or with ``size`` the largest, and the errors of all in order."""
    by = F.struct(F.col(size).alias("by"), (-F.col(order)).alias("at")) if size else F.struct((-F.col(order)).alias("by"), F.lit(0).alias("at"))
    return attempts.groupBy(key).agg(
        F.max_by("url", F.when(F.col("valid"), by)).alias("url"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct(order, "error")))), lambda x: x["error"]).alias("errors"))


def keep_last_good(new: DataFrame, previous: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``new`` where it has the fields, else the previous row's, marked ``preserved``."""
    old = previous.select(key, *[F.col(f).alias(f"_old_{f}") for f in fields])
    lost = F.col(fields[0]).isNull() & F.col(f"_old_{fields[0]}").isNotNull()
    joined = new.join(old, key, "left").withColumn("preserved", lost)
    return joined.select(*[F.when(F.col("preserved"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in new.columns], "preserved")
