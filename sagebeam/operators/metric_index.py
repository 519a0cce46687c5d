"""A stored index of 64-bit words by Hamming distance, which new words probe without a join of the store with itself.

Some words are pivots; every word belongs to the cell of its nearest pivot.  A block
is a file's row with words of one cell in ascending order of their distance to the
pivot, and the index knows each cell's largest such distance.  A new word is measured
against the pivots alone: by the triangle inequality, words within ``radius`` of it
lie only in cells whose largest distance it reaches, and there only at distances from
the pivot that differ from its own by no more than ``radius``.  Only these words are
compared, so the pairs are exactly those of a comparison with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebeam.operators.shared import bounded_batches, stored

#: Pivots at most (8 bytes each, to every task), words of a block, and probing words that meet a block together.
PIVOTS, BLOCK, PROBES = 4096, 1 << 16, 4096
_BLOCKS = "cell int, n int, words binary, far binary"


def distances(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Bits that differ, words by others."""
    return np.bitwise_count(words.view(np.uint64)[:, None] ^ others.view(np.uint64)[None, :])


def _cells(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_numpy()
            cell, far = np.empty(len(words), dtype=np.int32), np.empty(len(words), dtype=np.int32)
            for a in range(0, len(words), 1024):
                d = distances(words[a : a + 1024], pivots)
                cell[a : a + 1024] = d.argmin(axis=1)
                far[a : a + 1024] = d.min(axis=1)
            yield pa.record_batch([batch.column("word"), pa.array(cell), pa.array(far)], ["word", "cell", "far"])

    return run


def _packed(table: pa.Table) -> pa.Table:
    words, far = table.column("word").to_numpy(), table.column("far").to_numpy()
    order = np.lexsort((words, far))
    return pa.table({"cell": table.column("cell").slice(0, 1), "n": pa.array([len(words)], pa.int32()), "words": pa.array([words[order].tobytes()], pa.binary()), "far": pa.array([far[order].astype(np.uint8).tobytes()], pa.binary())})


def _blocks(words: DataFrame, pivots: np.ndarray) -> DataFrame:
    placed = stored(words.select("word").where("word is not null").distinct().mapInArrow(_cells(pivots), "word long, cell int, far int"), "metric-placed")
    # A row per cell.
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")))
    return dealt.select("cell", "part", "word", "far").groupBy("cell", "part").applyInArrow(_packed, _BLOCKS)


def build(words: DataFrame, path: str) -> None:
    """Write the index of the column ``word`` (long) to the folder ``path``; repeated words are one, nulls none."""
    spark = bounded_batches(words.sparkSession)
    known = words.select("word").where("word is not null").distinct()
    n = known.count()
    most = max(1, min(PIVOTS, int(np.ceil(np.sqrt(n)))))
    pivots = known.orderBy(F.xxhash64("word"), "word").limit(most)
    pivots.coalesce(1).write.parquet(f"{path}/pivots")
    _blocks(known, _pivots(spark, path)).write.parquet(f"{path}/blocks")


def extend(words: DataFrame, path: str) -> None:
    """Add words to an index: files are added, none is changed.  Words that are there already are not added again."""
    spark = words.sparkSession
    pivots = _pivots(spark, path)
    if len(pivots):
        fresh = words.select("word").join(probe(words, path, 0).select(F.col("new").alias("word")), "word", "left_anti")
        _blocks(fresh, pivots).write.mode("append").parquet(f"{path}/blocks")


def _pivots(spark: SparkSession, path: str) -> np.ndarray:
    return np.array(sorted(r["word"] for r in spark.read.schema("word long").parquet(f"{path}/pivots").collect()), dtype=np.int64)


def _sent(pivots: np.ndarray, reach: np.ndarray, radius: int):
    """Each word to the cells that may hold words near it, with its distance to their pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_numpy()
            for a in range(0, len(words), 1024):
                d = distances(words[a : a + 1024], pivots).astype(np.int32)
                i, cell = np.nonzero(d <= reach[None] + radius)
                yield pa.record_batch([pa.array(cell, pa.int32()), pa.array(words[a : a + 1024][i]), pa.array(d[i, cell])], ["cell", "word", "off"])

    return run


def _compared(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, far, asked in zip(batch.column("words"), batch.column("far"), batch.column("asked"), strict=True):
                own, at = np.frombuffer(words.as_py(), dtype=np.int64), np.frombuffer(far.as_py(), dtype=np.uint8).astype(np.int32)
                new, off = asked.values.field("word").to_numpy(), asked.values.field("off").to_numpy()
                # New words of one distance to the pivot share the stretch of words that they are compared with.
                for distance in np.unique(off):
                    lo, hi = np.searchsorted(at, [distance - radius, distance + radius + 1])
                    group = new[off == distance]
                    step = max(1, (1 << 22) // max(1, hi - lo))
                    for a in range(0, len(group) if hi > lo else 0, step):
                        d = distances(group[a : a + step], own[lo:hi])
                        i, j = np.nonzero(d <= radius)
                        yield pa.record_batch([pa.array(group[a : a + step][i]), pa.array(own[lo:hi][j]), pa.array(d[i, j].astype(np.int64))], ["new", "old", "distance"])

    return run


def probe(words: DataFrame, path: str, radius: int = 4) -> DataFrame:
    """(new, old, distance): every word of the column ``word`` with every indexed word at most ``radius`` bits from it, the equal one too.

    Repeated words ask once, nulls not at all; an index without words answers nothing.
    """
    spark = bounded_batches(words.sparkSession)
    pivots = _pivots(spark, path)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    reach = np.full(len(pivots), -65, dtype=np.int32)  # cells without words are reached by nothing
    # A row per cell: its last word is its farthest.
    for r in blocks.select("cell", F.conv(F.hex(F.expr("substring(far, n, 1)")), 16, 10).cast("int").alias("last")).groupBy("cell").agg(F.max("last").alias("last")).collect():
        reach[r["cell"]] = r["last"]
    asked = words.select("word").where("word is not null").distinct()
    sent = stored(asked.mapInArrow(_sent(pivots, reach, radius), "cell int, word long, off int"), "metric-sent")
    parts = sent.groupBy("cell").agg(F.ceil(F.count("*") / PROBES).alias("parts"))
    dealt = sent.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")))
    together = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("word", "off")).alias("asked"))
    return together.join(blocks, "cell").select("words", "far", "asked").mapInArrow(_compared(radius), "new long, old long, distance long")
