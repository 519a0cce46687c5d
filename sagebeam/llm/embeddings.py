"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Distinct vectors are dealt by hash into blocks; every pair of blocks is one tile
and one task.  In a tile the unit vectors are rounded to int8 with one scale a
block, and integer products are compared with a threshold lowered by each
vector's own rounding error: with x = s*q + e, |e| <= eps,
x.y <= s*t*(q.r) + eps_x*(1 + eps_y) + eps_y*(1 + eps_x) + eps_x*eps_y.
Only pairs that this leaves possible are computed in double precision.  A tile
sends back, for each of its vectors, how many rows link to it and the root of
its component within the tile, so the rows it makes never exceed those it reads,
however large a group of near copies is.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebeam.llm.frames import bounded_batches, components, discard, stored

#: Vectors of a block at most (a tile holds two), and vectors from which a table is cut into ``SPREAD`` blocks so that few vectors fill the tasks too.
BLOCK, SPREAD_FROM, SPREAD = 16_384, 2048, 8
_STRIP = 512
_EXACT = 1 << 16
#: Above this many dimensions int8 products no longer fit the 24 bits of a float32.
_FLOAT32_DIMS = (1 << 24) // (127 * 127)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Integers in -127..127 (as floats), their scale, and an upper bound of each row's rounding error."""
    scale = max(float(np.abs(unit).max(initial=0.0)), 1e-300) / 127
    q = np.rint(unit / scale)
    error = np.linalg.norm(unit - q * scale, axis=1) * (1 + 1e-9) + 1e-12
    return q.astype(np.float32 if unit.shape[1] <= _FLOAT32_DIMS else np.float64), scale, error


class _Forest:
    """Components of the rows of a tile, by minimum labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def tile_links(left: np.ndarray, right: np.ndarray | None, floor: float, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows linked to every vector (by the others' copies) and component labels; ``right`` None compares left with itself.

    Rows of the result are those of left and then of right.
    """
    rows = left if right is None else np.concatenate([left, right])
    # Scaled by a power of two, which is exact, so that squares neither vanish nor overflow.
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None])
    norms = np.linalg.norm(rows, axis=1)
    unit = rows / norms[:, None]
    n = len(left)
    qa, sa, ea = quantise(unit[:n])
    qb, sb, eb = (qa, sa, ea) if right is None else quantise(unit[n:])
    at = 0 if right is None else n
    slack = lambda x, y: x * (1 + y) + y * (1 + x) + x * y + 1e-9
    least = np.float64((floor - slack(ea.max(initial=0), eb.max(initial=0))) / (sa * sb))
    links, forest = np.zeros(len(rows), dtype=np.int64), _Forest(len(rows))
    for lo in range(0, n, _STRIP):
        product = qa[lo : lo + _STRIP] @ qb.T
        i, j = np.divmod(np.flatnonzero(product >= least), len(qb))
        value = product[i, j].astype(np.float64) * (sa * sb)
        i += lo
        keep = value + slack(ea[i], eb[j]) >= floor
        if right is None:
            keep &= i < j
        i, j = i[keep], j[keep] + at
        for k in range(0, len(i), _EXACT):
            a, b = i[k : k + _EXACT], j[k : k + _EXACT]
            cosine = np.einsum("ij,ij->i", rows[a], rows[b]) / (norms[a] * norms[b])
            a, b = a[cosine >= floor], b[cosine >= floor]
            links += np.bincount(a, weights=copies[b], minlength=len(rows)).astype(np.int64)
            links += np.bincount(b, weights=copies[a], minlength=len(rows)).astype(np.int64)
            forest.link(a, b)
    return links, forest.label


def _tiler(floor: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("part")
        node, part, copies = (table.column(c).to_numpy() for c in ("node", "part", "copies"))
        rows = pa.concat_arrays(table.column("vector").chunks).flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
        n = int((part == 0).sum())
        alone = table.column("ti")[0] == table.column("tj")[0]
        links, label = tile_links(rows[:n], None if alone else rows[n:], floor, copies)
        met = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[met], pa.int64()), "links": pa.array(links[met], pa.int64()), "root": pa.array(node[label[met]], pa.int64())})

    return run


def near_vectors(vectors: DataFrame, floor: float = 0.95) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    n_links counts the other rows whose cosine with this one is at least
    ``floor`` (exact copies included), component_id is the smallest vec_id
    reachable by links, itself included, and kept is vec_id = component_id.

    Vectors that are null, empty or zero, or hold a null or non-finite component,
    link with nothing; vectors of different lengths do not link.  Repeated rows
    are rows like any others.  A null vec_id takes part in links but names no
    component; where no member has an id, component_id and kept are null.  Only
    the two columns are read, so extra ones cannot clash.
    """
    spark = bounded_batches(vectors.sparkSession)
    wide = vectors.select("vec_id", F.expr("transform(embedding, x -> cast(x as double) + 0.0D)").alias("vector"))
    sound = "coalesce(size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0), false)"
    for seed in count():
        named, named_path = stored(wide.select("vec_id", "vector", F.when(F.expr(sound), F.xxhash64(F.lit(seed), "vector")).alias("node")), "embeddings-named")
        nodes, nodes_path = stored(named.where("node is not null").groupBy("node", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id")).withColumn("dims", F.size("vector")), "embeddings-nodes")
        # Two vectors of one hash would be taken for one; the next seed parts them.
        if not nodes.groupBy("node").count().where("count > 1").limit(1).count():
            break
        discard(spark, named_path, nodes_path)
    # Blocks are of vectors of one length; a driver-side row per length, of which there are few.
    sizes = {r["dims"]: max(math.ceil(r["n"] / BLOCK), min(SPREAD, math.ceil(r["n"] / SPREAD_FROM))) for r in nodes.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    blocks = F.element_at(F.create_map(*[F.lit(v) for kv in sizes.items() for v in kv]), F.col("dims")) if sizes else F.lit(1)
    tiles = sum(n * (n + 1) // 2 for n in sizes.values())
    dealt = (
        nodes.withColumn("blocks", blocks)
        .withColumn("own", F.expr("cast(pmod(xxhash64(node, 1), blocks) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("ti", F.least("own", "other")).withColumn("tj", F.greatest("own", "other"))
        .withColumn("part", F.when(F.col("own") == F.col("ti"), 0).otherwise(1)))
    dealt = dealt.select("dims", "ti", "tj", "part", "node", "copies", "vector").repartition(max(1, min(tiles, 20_000)), "dims", "ti", "tj")
    found, _ = stored(dealt.groupBy("dims", "ti", "tj").applyInArrow(_tiler(floor), "node long, links long, root long"), "embeddings-links")
    roots, _ = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "embeddings")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = nodes.select("node", "copies", "least_id").join(counted, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = joined.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = named.select("vec_id", "node").join(known, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
