"""Centroid clustering by Yinyang bounds, in exact whole-number arithmetic.

Centroids are put into groups once, by their first positions.  A vector keeps an
upper bound of the distance to its centroid and one lower bound per group, of
the distances to the group's other centroids.  When centroids move, bounds move
by as much.  Globally, a vector whose upper bound is below all its lower bounds
keeps its centroid unseen; else the upper bound is made exact and, group by
group, only groups whose lower bound it reaches are opened; of an open group,
only centroids that the group's old bound less their own move cannot exclude are
measured, exactly.  Equal distances never pass a filter, so ties are settled by
number.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagebeam.llm import lloyd
from sagebeam.llm.frames import stored
from sagebeam.llm.lloyd import FAR, MARGIN, Codebook, Rounds, root, squared, table_of

SCALE, DIMS, CENTROIDS, ROUNDS, SEED = 1024, 64, 8, 10, 3
#: Centroids of a group, on average.
GROUP = 4


def group_centroids(entries: list[list[int]], size: int = GROUP) -> list[np.ndarray]:
    """Numbers of the centroids of each group: a few rounds of clustering the centroids themselves, each group ascending."""
    points = np.array(entries, dtype=np.float64).reshape(len(entries), -1)
    n = max(1, math.ceil(len(points) / size))
    heads = points[:n].copy()
    for _ in range(5):
        own = ((points[:, None, :] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(n):
            if (own == g).any():
                heads[g] = points[own == g].mean(axis=0)
    return [np.flatnonzero(own == g) for g in range(n) if (own == g).any()]


def _bounds(squares: np.ndarray, near: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of the nearest, and lower bounds by group of the others."""
    rows = np.arange(len(squares))
    far = root(squares)
    upper = far[rows, near] * (1 + MARGIN)
    far[rows, near] = np.inf
    return upper, np.stack([far[:, g].min(axis=1) for g in groups], axis=1) * (1 - MARGIN)


def assign(x: np.ndarray, book: Codebook, groups: list[np.ndarray], near: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids, bounds, and how many distances were measured; ``near`` None: from nothing."""
    centroids = book.matrix(x)
    if near is None:
        squares = table_of(x, centroids)
        near = squares.argmin(axis=1)
        return near, *_bounds(squares, near, groups), squares.size
    before, drift = lower, book.drift
    upper = (upper + drift[near]) * (1 + MARGIN)
    lower = lower - np.array([drift[g].max() for g in groups]) - MARGIN * np.where(np.isfinite(lower), lower, 0)
    near = near.copy()
    rows = np.flatnonzero(upper >= lower.min(axis=1))
    value = squared(x[rows], centroids[near[rows]])
    measured = len(rows)
    upper[rows] = root(value) * (1 + MARGIN)
    open_ = upper[rows] >= lower[rows].min(axis=1)
    rows, value = rows[open_], value[open_]
    first, known = near[rows].copy(), value.copy()  # the old centroid and its exact distance now
    group_of = np.empty(len(centroids), dtype=np.int64)
    for g, members in enumerate(groups):
        group_of[members] = g
    best, best_value = first.copy(), value.copy()
    far = FAR[x.dtype.kind]
    for g, members in enumerate(groups):
        at = np.flatnonzero(root(best_value) * (1 + MARGIN) >= lower[rows, g])
        if not len(at):
            continue
        squares = np.full((len(at), len(members)), far, dtype=x.dtype)
        excluded = np.full(len(at), np.inf)  # least bound of the centroids not measured
        reach = root(best_value[at]) * (1 + MARGIN)
        for k, c in enumerate(members):
            own = first[at] == c
            squares[own, k] = np.where(best[at[own]] == c, far, known[at[own]])  # the present best is none of the others
            bound = (before[rows[at], g] - drift[c]) - MARGIN * np.where(np.isfinite(before[rows[at], g]), before[rows[at], g], 0)
            seen = ~own & (reach >= bound)
            squares[seen, k] = squared(x[rows[at[seen]]], centroids[c])
            measured += int(seen.sum())
            unseen = ~own & ~seen
            excluded[unseen] = np.minimum(excluded[unseen], bound[unseen])
        line = np.arange(len(at))
        nearest = squares.argmin(axis=1)
        least, number = squares[line, nearest], members[nearest]
        better = (least < best_value[at]) | ((least == best_value[at]) & (number < best[at]))
        won = line[better]
        squares[won, nearest[better]] = far
        lower[rows[at], g] = np.minimum(root(squares.min(axis=1)) * (1 - MARGIN), excluded)
        lost = at[won]
        old_group = group_of[best[lost]]
        lower[rows[lost], old_group] = np.minimum(lower[rows[lost], old_group], root(best_value[lost]) * (1 - MARGIN))
        best[lost], best_value[lost] = number[better], least[better]
    near[rows] = best
    upper[rows] = root(best_value) * (1 + MARGIN)
    return near, upper, lower, measured


def pack(near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> bytes:
    return near.astype("<i4").tobytes() + upper.astype("<f8").tobytes() + lower.astype("<f8").tobytes()


def unpack(memory: bytes, n: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    floats = np.frombuffer(memory, dtype="<f8", offset=4 * n)
    return np.frombuffer(memory, dtype="<i4", count=n).astype(np.int64), floats[:n].copy(), floats[n:].reshape(n, groups).copy()


def _stepped(groups: list[np.ndarray]):
    def step(x: np.ndarray, books: list[Codebook], memory: bytes | None) -> tuple[bytes, list[np.ndarray]]:
        was, upper, lower = unpack(memory, len(x), len(groups)) if memory else (None, None, None)
        near, upper, lower, _ = assign(x, books[0], groups, was, upper, lower)
        return pack(near, upper, lower), [lloyd.changes(x, was, near, len(books[0].entries))]

    return step


def _finish(groups: list[np.ndarray]):
    def finish(x: np.ndarray, books: list[Codebook], memory: bytes | None) -> list[pa.Array]:
        near, _, _, _ = assign(x, books[0], groups, *(unpack(memory, len(x), len(groups)) if memory else (None, None, None)))
        return [pa.array(near, pa.int32()), lloyd.longs(squared(x, books[0].matrix(x)[near]))]

    return finish


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """One row per vector of ``dims`` sound components of ``vectors`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components become floor(scale * x).  The first centroids are the vectors of
    the smallest sha256 of ``<seed>:<vec_id>``, in that order; ``rounds`` times all
    vectors go to the nearest centroid (ties: the smaller number) and centroids
    with vectors to the floor of their mean; then all are assigned once more.
    Rounds end early where no centroid moves, as all later ones would be equal.

    Rows whose vector is null, of another length, or holds a null or non-finite
    component are left out; with none left the result is empty.  Repeated rows
    are vectors like any others; those of one vec_id are ordered by components
    as first centroids, null ids come last.  With fewer vectors than
    ``centroids`` each is a first centroid.  Components beyond +-2^62 stay there;
    a distance, or a sum of them, that no long can hold is null.  Only the two
    columns are read, so extra ones cannot clash.
    """
    sound = vectors.where((F.size("embedding") == dims) & F.expr(lloyd.SOUND)).select("vec_id", "embedding")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = sound.orderBy(key.asc_nulls_last(), "embedding").limit(centroids).select("embedding").collect()
    work = Rounds(sound, ["vec_id"], scale, 1, "centroids")
    named = [("vec_id", vectors.schema["vec_id"].dataType), ("cluster", T.IntegerType()), ("distance", T.LongType())]
    if first:
        work.start(dims, np.array([lloyd.whole(np.array(r["embedding"], dtype=np.float64), scale) for r in first]))
        groups = group_centroids(work.books[dims][0].entries, group)
        for _ in range(rounds):
            work.pass_over(_stepped(groups))
            if not work.move():
                break
        final, _ = stored(work.last(_finish(groups), named[1:]).select(F.col("c0").alias("vec_id"), "cluster", "distance"), "centroids-final")
    else:
        final = vectors.sparkSession.createDataFrame([], T.StructType([T.StructField(k, t) for k, t in named]))
    work.close()
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    # One row a centroid.
    sums = final.groupBy("cluster").agg(total.alias("own"), F.count("distance").alias("known"), F.count("*").alias("n"))
    held = [(r["cluster"], r["own"], r["known"] == r["n"]) for r in sums.collect()]
    fits = lambda v: int(v) if v is not None and v < 2**63 else None
    inertia = fits(sum((r[1] for r in held if r[2]), 0)) if all(r[2] for r in held) else None
    digest = {i: hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for i, e in enumerate(work.books[dims][0].entries)} if first else {}
    facts = vectors.sparkSession.createDataFrame([(c, fits(own), inertia, digest[c]) for c, own, _ in held], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
