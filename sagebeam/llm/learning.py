"""What the classifiers share: folds, bounded samples, hashed n-grams of bytes, and linear models in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagebeam.llm import textkit as tk

_ROWS = 256


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % of).cast("int")


def stratified(rows: DataFrame, stratum: str, total: int) -> DataFrame:
    """At most about ``total`` rows, evenly over the strata as far as these have rows, chosen by a hash of doc_id.

    The same rows in every run.  The strata's counts reach the driver: a row each
    of a label or language column.  Rows that share a doc_id go in or stay out
    together.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(stratum).isNotNull()).groupBy(stratum).count().collect()}
    if not counts:
        return rows.where("false")
    left, share = total, {}
    for i, (k, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], str(x[0])))):
        own = min(n, left // (len(counts) - i))
        share[k], left = own / n, left - own
    wanted = F.element_at(F.create_map(*[F.lit(v) for kv in share.items() for v in kv]), F.col(stratum))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(F.col(stratum).isNotNull() & (unit < wanted))


#: Rows of a stratum that every shard has at least, as far as there are any: those of rare strata are in several shards.
LEAST_IN_SHARD = 64


def dealt(rows: DataFrame, stratum: str, counts: dict, size: int) -> DataFrame:
    """All ``rows`` with ``shard``, of about ``size`` rows each, and ``copy``; ``counts`` tells how many rows each value of ``stratum`` has.

    Every row is in a shard, chosen by a hash of doc_id and the same in every run.  So
    that each shard has rows of every stratum, rows of rare ones are in further
    shards too, as copies from 1 up; the copies of a stratum are at most
    ``LEAST_IN_SHARD`` for each shard.
    """
    shards = max(1, round(sum(counts.values()) / size))
    copies = F.element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(shards, -(-LEAST_IN_SHARD * shards // max(1, n))))]), F.col(stratum))
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    return many.withColumn("shard", F.pmod(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)) + F.col("copy"), F.lit(shards)).cast("int"))


VECTOR = "key string, shard int, x binary"


def summed(vectors: DataFrame) -> dict[str, np.ndarray]:
    """Sums of the ``vectors`` (of ``VECTOR``; x of 32-bit floats) by key, always in one order; only these sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(0)
        done = lambda: pa.record_batch([pa.array([at]), pa.array([total.tobytes()], pa.binary())], names=["key", "x"])
        for batch in batches:
            for key, x in zip(batch.column("key").to_pylist(), batch.column("x").to_pylist(), strict=True):
                x = np.frombuffer(x, dtype=np.float32).astype(np.float64)
                if key != at:
                    if at is not None:
                        yield done()
                    at, total = key, np.zeros(len(x))
                total += x
        if at is not None:
            yield done()

    found = vectors.repartition("key").sortWithinPartitions("key", "shard").mapInArrow(run, "key string, x binary").collect()
    return {r["key"]: np.frombuffer(bytes(r["x"]), dtype=np.float64) for r in found}


#: Letters of any script (ASCII folded, bytes from 0x80) as they are, all else a blank.
LETTERS = tk.FOLD.copy()
LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
#: Every byte as it is, but digits alike.
RAW = np.arange(256, dtype=np.uint8)
RAW[0x30:0x3A] = 0x30


def _fold_latin(data: np.ndarray) -> np.ndarray:
    """Lower case for the capitals of Latin-1 in UTF-8 (0xC3 and then 0x80 to 0x9E)."""
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    capital = after & (data >= 0x80) & (data <= 0x9E)
    return np.where(capital, data + np.uint8(0x20), data)


def ngrams(column: pa.Array, table: np.ndarray, dims: int, sizes: tuple[int, ...] = (1, 2, 3)) -> Iterator[tuple[int, int, np.ndarray]]:
    """(lo, hi, matrix): square roots of hashed n-gram counts of rows lo:hi, scaled to length 1; whole texts."""
    cuts, data = tk.buffers(column)
    shift = 64 - (dims - 1).bit_length()
    for lo, hi in tk.slices(cuts):
        for a in range(lo, hi, _ROWS):
            b = min(hi, a + _ROWS)
            total = np.zeros((b - a) * dims, dtype=np.float32)
            # A long text is counted in pieces, each with the two bytes before it.
            for at in range(cuts[a], max(cuts[b], cuts[a] + 1), tk.SLICE_BYTES):
                end = min(at + tk.SLICE_BYTES, cuts[b])
                begin = max(cuts[a], at - 2)
                own = table[_fold_latin(data[begin:end]) if table is LETTERS else data[begin:end]].astype(np.uint64)
                places = np.arange(begin, end)
                row = np.searchsorted(cuts[a + 1 : b + 1], places, side="right")
                for n in sizes:
                    last = places[n - 1 :]
                    new = (last >= at) & (last - cuts[a + row[n - 1 :]] >= n - 1)
                    code = np.full(len(last), n, dtype=np.uint64)
                    for k in range(n):
                        code = (code << np.uint64(8)) | own[k : len(own) - n + 1 + k]
                    key = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)
                    total += np.bincount((row[n - 1 :] * dims + key.astype(np.int64))[new], minlength=len(total))
            x = np.sqrt(total.reshape(b - a, dims))
            yield a, b, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def featurise(make: Callable[[pa.RecordBatch], np.ndarray], keep: list[str]):
    """For mapInArrow: the columns ``keep`` and the rows of a matrix as binaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ascontiguousarray(make(batch), dtype=np.float32)
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array([r.tobytes() for r in x], pa.binary())], names=[*keep, "x"])

    return run


def binaries(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of binaries, without an object for each."""
    whole = pa.concat_arrays([pa.array([], pa.large_binary()), *(c.cast(pa.large_binary()) for c in column.chunks)])
    _, offsets, data = whole.buffers()
    cuts = np.frombuffer(offsets, dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    return cuts - cuts[0], np.frombuffer(data, dtype=np.uint8)[cuts[0] : cuts[-1]] if data is not None and len(whole) else np.zeros(0, np.uint8)


def collected(rows: DataFrame) -> tuple[pa.Table, np.ndarray]:
    """A bounded sample on the driver: its table, in an order that no run changes, and its matrix."""
    table = rows.toArrow()
    _, data = binaries(table.column("x"))
    raw = data.view(np.float32).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1), dtype=np.float32)
    rest = table.drop_columns(["x"])
    keys = [(repr(tuple(r.values())), hashlib.blake2b(v, digest_size=16).digest()) for r, v in zip(rest.to_pylist(), raw, strict=True)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return rest.take(pa.array(order, pa.int64())), raw[order]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 120) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge loss, y of -1 and 1, classes weighed alike): weights and bias."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, dtype=np.float32)
    look, rate = w.copy(), 0.25  # rows have length 1 and a constant, so the loss's curvature is at most 2 * 2
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ look[:-1] + look[-1]))
        pull = weight * slack * y
        grad = -2 * np.append(x.T @ pull, pull.sum()) + 2 * ridge * look
        new = look - rate * grad
        look = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit_platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 30) -> tuple[float, float]:
    """Slope and offset so that sigmoid(slope * z + offset) is the share of y = 1, by damped Newton steps."""
    weight = np.ones(len(z)) if weight is None else weight
    a, b = 1.0, 0.0
    z, y = z.astype(np.float64), y.astype(np.float64)
    for _ in range(steps):
        p = sigmoid(a * z + b)
        g = np.array([(weight * (p - y) * z).sum() + 1e-3 * (a - 1), (weight * (p - y)).sum() + 1e-3 * b])
        v = weight * p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by accelerated gradient steps: weights and bias."""
    weight = (weight / max(weight.sum(), 1e-12)).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, dtype=np.float32)
    bound = 0.25 * (float(np.square(x).sum(axis=1).max(initial=0)) + 1) + ridge
    look = w.copy()
    for t in range(steps):
        pull = weight * (sigmoid(x @ look[:-1] + look[-1]) - y)
        new = look - (np.append(x.T @ pull, pull.sum()) + ridge * look) / bound
        look = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def appended(docs: DataFrame, fields: str, make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``docs`` with the columns ``fields`` (names and types, as in DDL, not taken yet), made batch by batch."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), fields])
    names = [f.split()[0].strip("`") for f in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, *make(batch)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
