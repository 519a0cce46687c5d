"""Exact Lloyd rounds over whole-number vectors: what centroid clustering and vector code compression share.

Vectors are rounded down to whole numbers once and packed into blocks, a row
for some thousands, in a table bucketed by block.  What a method remembers of a
block from round to round (assignments, bounds, heaps) is a row of another table
with the same buckets.  A round joins the two without a shuffle, and writes the
new memory, a small part of the vectors' size, next to how the moved vectors
change each centroid's sum and count; only these sums, whose number is fixed by
the codebooks, reach the driver.  A lost executor costs the tasks of one round.

All distances that decide are exact: whole numbers in doubles while they stay
below 2^53, else in 64 bits, else as Python integers.  Bounds are doubles with a
margin, and never decide a tie.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagebeam.llm.frames import discard, scratch, spread

#: Vectors and components of a block at most, vectors of a bucket on average, and buckets of a table at most (Spark's own limit).
BLOCK, COMPONENTS, BUCKET, MOST_BUCKETS = 2048, 1 << 20, 1 << 16, 100_000
#: Margin of bounds: far above the rounding of doubles, far below any slack worth keeping.
MARGIN = 1e-9
FAR = {"f": np.inf, "i": np.iinfo(np.int64).max, "O": float("inf")}
_MOST = np.iinfo(np.int64).max

#: Where a vector counts: no component null, NaN or infinite.
SOUND = "coalesce(forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false)"


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; beyond +-2^62 it stays there."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -(2.0**62), 2.0**62).astype(np.int64)


def exact(vectors: np.ndarray, most: int) -> np.ndarray:
    """Integers in the fastest type in which squared distances stay exact, where no component, of centroids neither, is beyond ``most``."""
    room = 4 * max(1, vectors.shape[1]) * most * most
    return vectors.astype(np.float64) if room < 2**53 else vectors.astype(np.int64) if room < 2**63 else vectors.astype(object)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to one centroid, or each to its own."""
    d = x - centroid
    return np.einsum("ij,ij->i", d, d) if d.dtype.kind == "f" else (d * d).sum(axis=1)


def table_of(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids."""
    if x.dtype.kind == "f":
        return np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ centroids.T) + np.einsum("ij,ij->i", centroids, centroids)
    return np.stack([squared(x, c) for c in centroids], axis=1)


def root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def two_nearest(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest column (ties to the smaller), its value, and the least value of the others (far where there is none)."""
    rows = np.arange(len(squares))
    near = squares.argmin(axis=1) if len(squares) else np.zeros(0, dtype=np.int64)
    value, rest = squares[rows, near], squares.copy()
    rest[rows, near] = FAR[squares.dtype.kind]
    return near, value, rest.min(axis=1) if len(squares) else value


def longs(values: np.ndarray) -> pa.Array:
    """As 64-bit integers; null where one does not fit."""
    return pa.array([int(v) if v <= _MOST else None for v in values], pa.int64()) if values.dtype.kind == "O" else pa.array(values.astype(np.int64))


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """``parts`` consecutive pieces of ``width``, equal where it can be divided."""
    return [(i * width // parts, (i + 1) * width // parts) for i in range(parts)]


@dataclass
class Codebook:
    """Centroids of one piece of the vectors, with the sums and counts of what is assigned to them."""

    entries: list[list[int]]
    drift: np.ndarray | None = None  # how far each entry moved last, never too small
    wander: np.ndarray | None = None  # per entry, all that it and the farthest mover of the others moved so far

    def __post_init__(self) -> None:
        n, width = len(self.entries), len(self.entries[0])
        self.sums, self.counts = [[0] * width for _ in range(n)], [0] * n
        self.drift, self.wander = np.zeros(n), np.zeros(n)

    def matrix(self, like: np.ndarray) -> np.ndarray:
        return np.array(self.entries, dtype=object).reshape(len(self.entries), -1).astype(like.dtype)

    def most(self) -> int:
        return max((abs(v) for e in self.entries for v in e), default=0)

    def add(self, changes: dict[int, int]) -> None:
        """Changes of counts and sums, each entry's count before its sums."""
        step = len(self.entries[0]) + 1
        for at, by in changes.items():
            entry, place = divmod(at, step)
            if place:
                self.sums[entry][place - 1] += by
            else:
                self.counts[entry] += by

    def move(self) -> bool:
        """Entries to the floor of their means; whether any moved."""
        fresh = [[s // n for s in total] if n else entry for total, n, entry in zip(self.sums, self.counts, self.entries)]
        far = np.array([float(sum((a - b) ** 2 for a, b in zip(x, y))) for x, y in zip(fresh, self.entries)])
        self.drift = np.sqrt(far) * (1 + MARGIN)
        others = [max((d for j, d in enumerate(self.drift) if j != i), default=0.0) for i in range(len(fresh))]
        self.wander = (self.wander + self.drift + others) * (1 + MARGIN)
        self.entries = fresh
        return bool(far.any())


def changes(x: np.ndarray, was: np.ndarray | None, now: np.ndarray, n: int) -> np.ndarray:
    """What moved rows add to counts and sums, flat as ``Codebook.add`` takes it; ``was`` None: all rows are new."""
    kind = x.dtype if x.dtype.kind == "O" else np.int64
    out = np.zeros((n, x.shape[1] + 1), dtype=kind)
    moved = np.arange(len(x)) if was is None else np.flatnonzero(was != now)
    one = np.concatenate([np.ones((len(moved), 1), dtype=kind), x[moved].astype(kind)], axis=1)
    np.add.at(out, now[moved], one)
    if was is not None:
        np.subtract.at(out, was[moved], one)
    return out.ravel()


def _decimals(values: np.ndarray) -> pa.Array:
    if values.dtype.kind == "O":
        return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))
    return pa.array(values, pa.int64()).cast(pa.decimal128(38, 0))


#: A method's step: (vectors of a block, codebooks of its pieces, memory or None) to (memory, changes per piece).
Step = Callable[[np.ndarray, list[Codebook], bytes | None], tuple[bytes, list[np.ndarray]]]


def _packer(carry: list[str], scale: int, schema: pa.Schema):
    def block(rows: pa.Table, dims: int) -> pa.RecordBatch:
        values = pa.concat_arrays(rows.column("embedding").chunks).flatten().to_numpy(zero_copy_only=False)
        ints = whole(values, scale)
        most = int(np.abs(ints).max(initial=0))
        small = ints.astype(next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max))
        lists = [pa.array([rows.column(c).to_pylist()], schema.field(c).type) for c in carry]
        return pa.record_batch([pa.array([dims], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([most], pa.int64()), pa.array([small.tobytes()], pa.binary()), *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}
        for batch in batches:
            whole_batch = pa.Table.from_batches([batch])
            sizes = pa.compute.list_value_length(batch.column("embedding")).to_numpy()
            for dims in np.unique(sizes).tolist():
                held.setdefault(dims, []).append(whole_batch.filter(pa.array(sizes == dims)))
                most = max(1, min(BLOCK, COMPONENTS // max(1, dims)))
                if sum(len(t) for t in held[dims]) >= most:
                    rows = pa.concat_tables(held.pop(dims))
                    for at in range(0, len(rows), most):
                        yield block(rows.slice(at, most), dims)
        for dims, parts in held.items():
            yield block(pa.concat_tables(parts), dims)

    return run


class Rounds:
    """The vectors of a table, packed, and the rounds of a method over them.

    ``carry`` are columns that the last pass hands on.  Vectors of different
    lengths have codebooks of their own; the lengths are taken to be few.
    """

    def __init__(self, vectors: DataFrame, carry: list[str], scale: int, pieces: int, name: str):
        self.spark, self.pieces, self.name, self.memory = vectors.sparkSession, pieces, name, None
        self.tables: list[tuple[str, str]] = []
        self.carried = T.StructType([T.StructField(f"c{i}", vectors.schema[c].dataType) for i, c in enumerate(carry)])
        rows = vectors.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.expr("transform(embedding, x -> cast(x as double))").alias("embedding"))
        n = rows.count()
        self.buckets = max(1, min(MOST_BUCKETS, max(self.spark.sparkContext.defaultParallelism, -(-n // BUCKET)))) if n else 1
        names = [f.name for f in self.carried]
        packed = T.StructType([T.StructField("dims", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("most", T.LongType()), T.StructField("vectors", T.BinaryType()), *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.carried]])
        from pyspark.sql.pandas.types import to_arrow_schema

        blocks = spread(rows).mapInArrow(_packer(names, scale, to_arrow_schema(packed)), packed)
        self.blocks = self._bucketed(blocks.withColumn("block", F.monotonically_increasing_id()).repartition(self.buckets, "block"), "blocks")
        self.books: dict[int, list[Codebook]] = {}

    def _bucketed(self, rows: DataFrame, what: str) -> str:
        table, path = f"sagebeam_{uuid.uuid4().hex[:16]}", scratch(self.spark, f"{self.name}-{what}")
        rows.write.bucketBy(self.buckets, "block").option("path", path).saveAsTable(table)
        self.tables.append((table, path))
        return table

    def lengths(self) -> list[int]:
        return sorted(r[0] for r in self.spark.table(self.blocks).select("dims").distinct().collect())

    def start(self, dims: int, vectors: np.ndarray) -> None:
        """Codebooks of vectors of length ``dims`` begin as the pieces of these whole-number vectors."""
        self.books[dims] = [Codebook([[int(v) for v in row[a:b]] for row in vectors]) for a, b in cuts(dims, self.pieces)]

    def _rows(self) -> DataFrame:
        blocks = self.spark.table(self.blocks)
        return blocks.join(self.spark.table(self.memory).select("block", "memory").hint("shuffle_hash"), "block", "left") if self.memory else blocks.withColumn("memory", F.lit(None).cast("binary"))

    def pass_over(self, step: Step) -> None:
        """One round: all blocks are assigned by ``step``, then the codebooks take the sums."""
        told, spark = self.spark.sparkContext.broadcast(self.books), self.spark

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, dims, n, most, packed, memory in zip(*(batch.column(c).to_pylist() for c in ("block", "dims", "n", "most", "vectors", "memory"))):
                    x, books = unpack(packed, (n, dims), most, told.value)
                    kept, deltas = step(x, books, memory)
                    flat = np.concatenate(deltas)
                    at = np.flatnonzero(flat)
                    moves = pa.StructArray.from_arrays([pa.array(at, pa.int32()), _decimals(flat[at])], ["at", "by"])
                    yield pa.record_batch([pa.array([block], pa.int64()), pa.array([dims], pa.int32()), pa.array([kept], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), moves)], ["block", "dims", "memory", "moves"])

        rows = self._rows().select("block", "dims", "n", "most", "vectors", "memory").mapInArrow(run, "block long, dims int, memory binary, moves array<struct<at:int,by:decimal(38,0)>>")
        fresh = self._bucketed(rows, "memory")
        told.destroy()
        if self.memory:
            self._drop(self.memory)
        self.memory = fresh
        # As many sums as the codebooks have numbers.
        sums = spark.table(fresh).select("dims", F.inline("moves")).groupBy("dims", "at").agg(F.sum("by").alias("by")).collect()
        for dims, books in self.books.items():
            mine, base = {r["at"]: int(r["by"]) for r in sums if r["dims"] == dims}, 0
            for book in books:
                size = len(book.entries) * (len(book.entries[0]) + 1)
                book.add({at - base: by for at, by in mine.items() if base <= at < base + size})
                base += size

    def move(self) -> bool:
        """All codebooks to their means; whether any entry moved."""
        return any([book.move() for books in self.books.values() for book in books])

    def last(self, finish: Callable[[np.ndarray, list[Codebook], bytes | None], list[pa.Array]], fields: list[tuple[str, T.DataType]]) -> DataFrame:
        """One row per vector: dims, the carried columns and those that ``finish`` tells of a block."""
        told, names = self.spark.sparkContext.broadcast(self.books), [f.name for f in self.carried]
        schema = T.StructType([T.StructField("dims", T.IntegerType()), *self.carried, *[T.StructField(k, t) for k, t in fields]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    row = batch.slice(i, 1)
                    dims, n, most, packed, memory = (row.column(c)[0].as_py() for c in ("dims", "n", "most", "vectors", "memory"))
                    x, books = unpack(packed, (n, dims), most, told.value)
                    found = finish(x, books, memory)
                    yield pa.record_batch([pa.array(np.full(len(x), dims), pa.int32()), *[row.column(c).flatten() for c in names], *found], ["dims", *names, *[k for k, _ in fields]])

        return self._rows().select("dims", "n", "most", "vectors", "memory", *names).mapInArrow(run, schema)

    def _drop(self, table: str) -> None:
        path = next(p for t, p in self.tables if t == table)
        self.tables.remove((table, path))
        self.spark.sql(f"drop table if exists {table}")
        discard(self.spark, path)

    def close(self) -> None:
        for table, _ in list(self.tables):
            self._drop(table)


def unpack(packed: bytes, shape: tuple[int, int], most: int, books: dict[int, list[Codebook]]) -> tuple[np.ndarray, list[Codebook]]:
    kind = next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max)
    own = books[shape[1]]
    return exact(np.frombuffer(packed, dtype=kind).reshape(shape), max(most, *(b.most() for b in own))), own
