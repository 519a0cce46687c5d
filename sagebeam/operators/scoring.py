"""The best records of many cases by signed, sparse weights of the marks that records bear.

A record bears marks (a sign that speaks for it, one that speaks against it, a
stage, a category), a case weighs some of them.  Records' marks are numbered once
and stored; a block of cases is a sparse matrix of marks by cases, broadcast after
a check of its size, and all blocks share one numbering while their marks fit.
Each task multiplies its records with the block and remembers the best of each
case, so that a pair of case and record is never a row, however common a mark is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebeam.operators.shared import stored

#: Weighed marks of a block of cases (12 bytes each, broadcast), different marks of a block, and cells of a dense tile in a task.
WEIGHTS, MARKS, CELLS = 4_000_000, 1_000_000, 1 << 22

#: Weights of a block: (kind of the weighed mark, how many records bear the mark that it is counted by) to weights.
Weigher = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _numberer(known):
    """Marks of records as numbers of the block's marks, others left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = known.value
        for batch in batches:
            lists = batch.column("marks")
            number = pc.index_in(pc.list_flatten(lists), marks)
            has = number.is_valid()
            of, at = pc.list_parent_indices(lists).filter(has).to_numpy(), number.filter(has)
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(batch)))])
            yield pa.record_batch([batch.column("record_id"), batch.column("pos"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), at)], ["record_id", "pos", "marks"])

    return run


class _Best:
    """The k best records of each case so far: scores, places in the order of ties, and records."""

    def __init__(self, cases: int, k: int):
        self.score = np.zeros((cases, k))
        self.pos, self.rec = np.full((cases, k), np.iinfo(np.int64).max), np.full((cases, k), -1, dtype=np.int64)

    def meet(self, lo: int, score: np.ndarray, pos: np.ndarray, rec: np.ndarray) -> None:
        """Records in ascending order of (pos, rec) with their scores (records by cases) for the cases from ``lo``."""
        n, cases = score.shape
        k = self.score.shape[1]
        # Twice a score is whole; what is left of the number tells the order among equal scores.
        key = np.rint(score * 2).astype(np.int64) * n + np.arange(n - 1, -1, -1)[:, None]
        row = np.argpartition(-key, min(k, n) - 1, axis=0)[: min(k, n)].T
        here = slice(lo, lo + cases)
        all_score = np.concatenate([self.score[here], np.take_along_axis(score.T, row, axis=1)], axis=1)
        all_pos, all_rec = np.concatenate([self.pos[here], pos[row]], axis=1), np.concatenate([self.rec[here], rec[row]], axis=1)
        order = np.lexsort((all_rec, all_pos, -all_score), axis=1)[:, :k]
        self.score[here], self.pos[here], self.rec[here] = (np.take_along_axis(a, order, axis=1) for a in (all_score, all_pos, all_rec))


def _scorer(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, cases, weights, n_cases = block.value  # by mark: where its cases begin, their numbers, their weights
        best = _Best(n_cases, k)
        for batch in batches:
            order = np.lexsort((batch.column("rec").to_numpy(), batch.column("pos").to_numpy()))
            batch = batch.take(pa.array(order))
            pos, rec, lists = batch.column("pos").to_numpy(), batch.column("rec").to_numpy(), batch.column("marks")
            of, at = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy()
            seen, column = np.unique(at, return_inverse=True)
            # The weights of the marks that the batch bears, by cases.
            sizes = starts[seen + 1] - starts[seen]
            spot = np.repeat(starts[seen] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(seen) else np.zeros(0, dtype=np.int64)
            mark, case, weight = np.repeat(np.arange(len(seen)), sizes), cases[spot], weights[spot]
            tall = max(1, CELLS // max(1, len(seen)))
            for a in range(0, len(batch), tall):
                rows = (of >= a) & (of < a + tall)
                n = min(tall, len(batch) - a)
                held = np.bincount((of[rows] - a) * len(seen) + column[rows], minlength=n * len(seen)).reshape(n, len(seen)).astype(np.float32)  # a sign listed twice counts twice
                wide = max(1, CELLS // max(1, len(seen), n))
                for lo in range(0, n_cases, wide):
                    own = (case >= lo) & (case < lo + wide)
                    tile = np.zeros((len(seen), min(wide, n_cases - lo)), dtype=np.float32)
                    np.add.at(tile, (mark[own], case[own] - lo), weight[own])
                    # Sums of multiples of a half are exact.
                    best.meet(lo, (held @ tile).astype(np.float64), pos[a : a + tall], rec[a : a + tall])
        i, j = np.nonzero((best.score > 0) & (best.rec >= 0))
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(best.rec[i, j], pa.int64()), pa.array(best.score[i, j])], ["case", "rec", "score"])

    return run


def best_records(marked: DataFrame, wanted: DataFrame, weigher: Weigher, k: int) -> DataFrame:
    """(case_id, record_id, pos, score): the k records of the largest positive score of each case, ties by ``pos``, and perhaps more; a further choice by case is due.

    ``marked`` has (record_id, pos long, marks array<string>), ``wanted`` (case_id,
    mark, counted, kind): for each case the marks that it weighs, the mark by
    whose number of records ``weigher`` tells the weight (a multiple of a half)
    and the kind to tell it by.  A mark that a record bears twice counts twice;
    in numbers of records it counts once.  Ids may be of any type.  Null marks
    are left out.
    """
    spark = marked.sparkSession
    n_weights, n_marks = wanted.agg(F.count("*"), F.countDistinct("mark")).first()
    blocks = max(1, -(-n_weights // WEIGHTS), -(-2 * n_marks // MARKS))
    if blocks > 1:
        marked = stored(marked.select("record_id", "pos", "marks"), "scoring-marked")
    record_type = marked.schema["record_id"].dataType.simpleString()
    found = None
    for b in range(blocks):
        own = (wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("case_id"), F.lit(blocks)) == b)).select("case_id", "mark", "counted", "kind").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        marks = pc.unique(pa.chunked_array([*own.column("mark").chunks, *own.column("counted").chunks]))
        known = spark.sparkContext.broadcast(marks)
        numbered = marked.select("record_id", "pos", "marks").mapInArrow(_numberer(known), f"record_id {record_type}, pos long, marks array<int>")
        numbered = stored(numbered.withColumn("rec", F.monotonically_increasing_id()), "scoring-numbered")
        known.destroy()
        # At most a row per mark of the block.
        borne = np.zeros(len(marks), dtype=np.int64)
        counted = numbered.select(F.explode(F.array_distinct("marks")).alias("mark")).groupBy("mark").agg(F.count("*").alias("n")).toArrow()
        borne[counted.column("mark").to_numpy()] = counted.column("n").to_numpy()
        mark, by = (pc.index_in(own.column(c), marks).to_numpy() for c in ("mark", "counted"))
        ids = pc.unique(own.column("case_id"))
        case, weights = pc.index_in(own.column("case_id"), ids).to_numpy(), weigher(own.column("kind").to_numpy(), borne[by])
        order = np.argsort(mark, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(mark, minlength=len(marks)))])
        block = spark.sparkContext.broadcast((starts, case[order], weights[order].astype(np.float32), len(ids)))
        part = stored(numbered.where(F.size("marks") > 0).select("rec", "pos", "marks").mapInArrow(_scorer(block, k), "case int, rec long, score double"), "scoring-best")
        block.destroy()
        names = spark.createDataFrame(pa.table({"case": pa.array(np.arange(len(ids)), pa.int32()), "case_id": ids}))
        part = part.join(F.broadcast(names), "case").join(numbered.select("rec", "record_id", "pos"), "rec").select("case_id", "record_id", "pos", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = wanted.select("case_id").limit(0).crossJoin(marked.select("record_id", "pos").limit(0)).withColumn("score", F.lit(0.0))
    return found
