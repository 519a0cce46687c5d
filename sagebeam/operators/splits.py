"""Leakage checks and the search for a split by whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebeam.operators.shared import stored

TARGETS = {"train": 0.6, "validation": 0.2, "test": 0.2}
EMPTY_PENALTY = 1000.0
#: Groups whose pairs give the first bound, groups of a block, and cells of a tile's array.
SEEDS, BLOCK, CELLS = 64, 512, 1 << 22


def leakage(rows: DataFrame, group: str, split: str, first: str, second: str) -> DataFrame:
    """(group, n_first, n_second) of groups that have rows in both splits."""
    return rows.groupBy(group).agg(F.count_if(F.col(split) == first).alias("n_first"), F.count_if(F.col(split) == second).alias("n_second")).where("n_first > 0 and n_second > 0")


def group_profile(rows: DataFrame, group: str, split: str, label: str) -> DataFrame:
    """Rows, rows by split and rows by label of every group, as maps."""
    by = lambda c: rows.groupBy(group, c).count().groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "count")))).alias(f"by_{c}"))
    return rows.groupBy(group).agg(F.count("*").alias("n")).join(by(split), group).join(by(label), group)


def _part(counts: np.ndarray, sizes: np.ndarray, shares: np.ndarray, total: float, target: float) -> np.ndarray:
    """Of parts with these label counts (last axis) and sizes: how far their label shares are from all rows', and half how far their size is from its target."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = np.abs(counts / sizes[..., None] - shares).sum(axis=-1) + 0.5 * np.abs(sizes / total - target)
    return np.where(sizes > 0, gap, EMPTY_PENALTY)


def _best(names: list, vectors: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, all_n: np.ndarray, best: tuple | None = None) -> tuple | None:
    """The better of ``best`` and the best (score, validation, test) with one group of ``left`` and one of ``right`` (numbers), either way round.

    ``own`` has each group's cost as validation and as test part.  Of equal scores the
    pair that takes larger groups out stands, as it leaves smaller ones to train on.
    """
    total, shares, sizes = all_n.sum(), all_n / all_n.sum(), vectors.sum(axis=1)
    step = max(1, CELLS // max(1, len(right) * vectors.shape[1]))
    for a in range(0, len(left), step):
        v = left[a : a + step]
        rest = all_n - vectors[v][:, None, :] - vectors[right][None]
        train = _part(rest, total - sizes[v][:, None] - sizes[right][None], shares, total, TARGETS["train"])
        for first, second, turned in ((own[v, 0], own[right, 1], False), (own[v, 1], own[right, 0], True)):
            score = np.round(train + first[:, None] + second[None], 6)
            score[v[:, None] == right[None]] = np.inf
            least = score.min(initial=np.inf)
            if not np.isfinite(least) or (best is not None and least > best[0]):
                continue
            for i, j in zip(*np.nonzero(score == least), strict=True):
                pair = (names[right[j]], names[v[i]]) if turned else (names[v[i]], names[right[j]])
                if best is None or least < best[0] or _order(pair) > _order(best[1:]) or (_order(pair) == _order(best[1:]) and pair[0] < best[1]):
                    best = (float(least), *pair)
    return best


def _order(pair: tuple) -> tuple:
    return min(pair), max(pair)


def choose_split(rows: DataFrame, group: str, label: str, unknown: str = "DS090-UNKNOWN") -> DataFrame:
    """The pair of groups, one for validation and one for testing, that keeps label shares closest to the whole.

    (validation_group, test_group, score): for each part the summed difference of its
    label shares from all rows', half the difference of its size from its target, or
    a penalty if it is empty.  Ties (at six digits) go to the pair whose smaller and
    then larger group is larger, then to the smaller validation group.  Fewer than
    three groups give no row; a null group is none, null labels are equal.

    What a group costs as validation and as test part is its own; a pair costs
    their sum and the training part's cost, which is not below 0.  The best pair
    among the cheapest groups is a bound, which drops all groups that cannot be in a
    pair as good.  The others are blocks by cost; pairs of blocks whose least costs
    together exceed the bound are not looked at, and each of the rest is a tile that
    returns its best pair.  Labels are few; a row of each reaches the driver.
    """
    spark = rows.sparkSession
    known = rows.where(F.col(group).isNotNull() & (F.col(group).cast("string") != unknown))
    kind = rows.schema[group].dataType.simpleString()
    counts = stored(known.groupBy(F.col(group).alias("g"), F.col(label).cast("string").alias("label")).agg(F.count("*").cast("double").alias("n")), "split-counts")
    schema = f"validation_group {kind}, test_group {kind}, score double"
    labels = {r["label"]: (i, r["n"]) for i, r in enumerate(counts.groupBy("label").agg(F.sum("n").alias("n")).collect())}
    all_n = np.array([n for _, n in labels.values()])

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.zeros((len(batch), len(all_n)))
            for i, own in enumerate(batch.column("own").to_pylist()):
                for x in own:
                    vectors[i, labels[x["label"]][0]] = x["n"]
            parts = [_part(vectors, vectors.sum(axis=1), all_n / all_n.sum(), all_n.sum(), TARGETS[k]) for k in ("validation", "test")]
            yield pa.record_batch([batch.column("g"), *(pa.array(x) for x in parts), pa.array([v.tobytes() for v in vectors], pa.binary())], ["g", "as_validation", "as_test", "vector"])

    whole = counts.groupBy("g").agg(F.collect_list(F.struct("label", "n")).alias("own"))
    groups = stored(whole.mapInArrow(costs, f"g {kind}, as_validation double, as_test double, vector binary"), "split-groups")
    n, low_v, low_t = groups.agg(F.count("*"), F.min("as_validation"), F.min("as_test")).first()
    if n < 3:
        return spark.createDataFrame([], schema)
    cost = F.col("as_validation") + F.col("as_test")
    seeds = groups.orderBy(cost, "g").limit(SEEDS).collect()
    vectors, own = np.stack([np.frombuffer(r["vector"]) for r in seeds]), np.array([[r["as_validation"], r["as_test"]] for r in seeds])
    every = np.arange(len(seeds))
    bound = _best([r["g"] for r in seeds], vectors, own, every, every, all_n)[0] + 1e-5
    kept = groups.where((F.col("as_validation") + low_t <= bound) | (F.col("as_test") + low_v <= bound)).withColumn("cost", cost)
    size = kept.count()
    edges = sorted(set(kept.approxQuantile("cost", [i / (size // BLOCK + 1) for i in range(1, size // BLOCK + 1)], 0.2 / (size // BLOCK + 1)))) if size > BLOCK else []
    place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e < F.col("cost")))
    # Groups of one cost may be many: they are parted by hash.
    wide = kept.withColumn("band", place)
    parts = wide.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    blocked = stored(wide.join(F.broadcast(parts), "band").withColumn("block", F.concat_ws("-", "band", F.pmod(F.xxhash64("g"), F.col("parts")))).drop("band", "parts", "cost"), "split-blocks")
    lows = blocked.groupBy("block").agg(F.min("as_validation").alias("v"), F.min("as_test").alias("t")).orderBy("block").collect()
    v, t = np.array([r["v"] for r in lows]), np.array([r["t"] for r in lows])
    i, j = np.nonzero(np.triu((v[:, None] + t[None] <= bound) | (t[:, None] + v[None] <= bound)))
    names = [r["block"] for r in lows]
    sides = [(int(k), names[b], side) for k, (x, y) in enumerate(zip(i, j, strict=True)) for b, side in (((x, 0), (y, 1)) if x != y else ((x, 2),))]
    tiles = spark.createDataFrame(sides, "tile int, block string, side int")

    def tile(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        vectors = np.stack([np.frombuffer(x) for x in table.column("vector").to_pylist()])
        own = np.stack([table.column(c).to_numpy() for c in ("as_validation", "as_test")], axis=1)
        found = _best(table.column("g").to_pylist(), vectors, own, np.flatnonzero(side != 1), np.flatnonzero(side != 0), all_n)
        out = [] if found is None else [found]
        return pa.table({"validation_group": pa.array([f[1] for f in out], table.schema.field("g").type), "test_group": pa.array([f[2] for f in out], table.schema.field("g").type), "score": pa.array([f[0] for f in out], pa.float64())})

    best = blocked.join(F.broadcast(tiles), "block").drop("block").groupBy("tile").applyInArrow(tile, schema)
    outer = F.greatest("validation_group", "test_group"), F.least("validation_group", "test_group")
    return best.orderBy("score", F.desc(outer[1]), F.desc(outer[0]), "validation_group").limit(1)
