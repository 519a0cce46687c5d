"""Greedy packing, largest first into the least loaded bin, by runs of equal sizes.

Where a run of m items of one size goes follows from the loads before it: bin i takes
its j-th item of the run at a load of L_i + j * size, and the run's items fill these
places in the order of load and bin, as water does.  From one bin's level to the next
the same bins take turns, so a run is told by a few stretches of ranks, each with the
bins that take turns in it.  Only the different sizes of a group are gone through in
order, in one task that keeps a number per bin; items are ranked by ranges and take
their bin from their run's stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagebeam.operators.shared import stored


def fill(loads: list[int], size: int, n: int) -> list[tuple[int, list[int]]]:
    """Stretches (first rank, bins that take turns) of n items of one size; ``loads`` become those after them."""
    if size == 0:
        return [(0, [min(range(len(loads)), key=lambda i: (loads[i], i))])]
    # A load is a floor, so many sizes high, and the rest above it; bins of a floor take turns by the rest.
    floor, rest = [v // size for v in loads], [v % size for v in loads]
    turn = sorted(range(len(loads)), key=lambda i: (rest[i], i))
    out, rank, level = [], 0, min(floor)
    while rank < n:
        bins = [i for i in turn if floor[i] <= level]
        later = [f for f in floor if f > level]
        rounds = min(later) - level if later else None
        take = n - rank if rounds is None else min(n - rank, rounds * len(bins))
        out.append((rank, bins))
        for k, i in enumerate(bins):
            loads[i] += size * (take // len(bins) + (k < take % len(bins)))
        rank += take
        level += rounds or 0
    return out


def _ranked(items: DataFrame, group: list[str], name: str, size: str) -> DataFrame:
    """``items`` with _rank, the place by name among those of one group and size, from 0: ranges are sorted apart and count on from each other."""
    spark = items.sparkSession
    order = [*group, F.desc(size), F.lower(name), F.col(name)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = items.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = stored(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "packing-placed")
    # A row per range, group and size.
    starts = placed.groupBy("_part", *group, size).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group, size).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.withColumn("_before", F.coalesce(before, F.lit(0))).select("_first", "_before", "_part", *[F.col(c).alias(f"_k{i}") for i, c in enumerate([*group, size])])
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate([*group, size]):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    met = placed.join(starts.withColumnRenamed("_part", "_p"), same)
    return met.withColumn("_rank", F.col("_before") + F.col("_at") - F.col("_first")).select(*items.columns, "_rank")


def pack(items: DataFrame, group: list[str], name: str, size: str, bins: int) -> DataFrame:
    """``items`` with the bin (from 0): largest first, then by lower-case name and name, into the least loaded bin, the first of equals.

    Sizes are whole numbers of at least 0, null as 0.  Items of one group, size and
    name are alike and share their ranks in any order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    if kinds[size] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{size} must be a whole number, not {kinds[size]}")
    known = items.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    sound = known.where(F.when(F.col("_size") < 0, F.raise_error(F.lit("a size is below 0")).cast("boolean")).isNull())
    ranked = _ranked(sound, group, name, "_size")
    runs = ranked.groupBy(*group, "_size").agg(F.count("*").alias("_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, loads = object(), []
        for batch in batches:
            keys = list(zip(*(batch.column(g).to_pylist() for g in group), strict=True)) if group else [()] * batch.num_rows
            turns = []
            for k, s, n in zip(keys, batch.column("_size").to_pylist(), batch.column("_n").to_pylist(), strict=True):
                if k != at:
                    at, loads = k, [0] * bins
                turns.append([{"first": first, "bins": own} for first, own in fill(loads, s, n)])
            yield pa.record_batch([*(batch.column(g) for g in group), batch.column("_size"), pa.array(turns, pa.list_(pa.struct([("first", pa.int64()), ("bins", pa.list_(pa.int32()))])))], names=[*group, "_size", "_turns"])

    # The different sizes of a group, in order, one task for a group; without one, for all.
    ordered = (runs.repartition(*group) if group else runs.coalesce(1)).sortWithinPartitions(*group, F.desc("_size"))
    told = ordered.mapInArrow(run, ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "_size long", "_turns array<struct<first:bigint,bins:array<int>>>"]))
    told = told.select("_turns", *[F.col(c).alias(f"_k{i}") for i, c in enumerate([*group, "_size"])])
    same = F.lit(True)
    for i, c in enumerate([*group, "_size"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    own = F.element_at(F.filter("_turns", lambda x: x["first"] <= F.col("_rank")), -1)
    bin_ = F.get(own["bins"], ((F.col("_rank") - own["first"]) % F.size(own["bins"])).cast("int"))
    return ranked.join(told, same).select(*items.columns, bin_.alias("bin"))
