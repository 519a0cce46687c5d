"""Quality scores by co-training of a text view and a page-metadata view.

The text view reads hashed byte n-grams of the whole text; the metadata view
reads source, language and size alone.  Both start from the labelled rows of a
bounded sample.  Every round takes a slice of its own of all documents, so that
after the last round each has been looked at once.  In its slice each view labels
the rows that it is sure of, beyond the middle margin of the labelled rows of that
label, and hands them to the other view, as sums of features: every task adds up
what it finds by view, label and group, Spark adds up the tasks, and the other view
learns from the groups' means beside the labelled rows.  At the end each view's
margin is calibrated on labelled rows kept apart, and the score combines the two
calibrated log odds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebeam.llm import learning
from sagebeam.llm import textkit as tk
from sagebeam.llm.frames import bounded_batches, fresh

NGRAM_DIMS, SHAPES, META_DIMS = 1024, 6, 1024
TEXT_DIMS = NGRAM_DIMS + SHAPES
#: Labelled rows at most.
SAMPLE = 3000
ROUNDS = 4
#: Groups that the rows handed over with a label are added up in, and what all of them count beside the labelled rows of that label.
GROUPS, HANDED = 16, 0.5
#: Features are added up as whole numbers of this part, so that no order of rows changes a sum.
_UNIT = float(1 << 20)
THRESHOLD = 0.5


_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?"]] = True


def _shapes(words: tk.Words) -> np.ndarray:
    """Shares that tell a text's shape whatever its length: capitals, symbols, symbols a word, words that repeat
    the one before, distinct words, and a constant."""

    def of(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[cuts])

    h, n = words.hashes(), np.maximum(words.counts(), 1)
    letters = np.maximum(of(_LETTER[words.data], words.cuts), 1)
    symbols = of(_SYMBOL[words.data], words.cuts)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = h[1:] == h[:-1]
    again[words.bounds[:-1][words.counts() > 0]] = False
    rows = words.rows()
    order = np.lexsort((h, rows))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    distinct = np.bincount(rows[order][new], minlength=len(n))
    size = np.maximum(np.diff(words.cuts), 1)
    return np.stack([of(_UPPER[words.data], words.cuts) / letters, np.minimum(1, 4 * symbols / size), np.minimum(1, symbols / n), of(again, words.bounds) / n, distinct / n, np.ones(len(n))], axis=1).astype(np.float32)


def text_features(texts: pa.Array) -> np.ndarray:
    """Hashed n-grams beside the shape of the text, which short texts are judged by."""
    grams = [x for _, _, x in learning.ngrams(texts, learning.RAW, NGRAM_DIMS)]
    shapes = [_shapes(w) for w in tk.words(texts, tk.ALNUM)]
    return np.concatenate([np.concatenate(grams), 2 * np.concatenate(shapes)], axis=1) if grams else np.zeros((0, TEXT_DIMS), dtype=np.float32)


def meta_features(batch: pa.RecordBatch) -> np.ndarray:
    """One bucket each for source, language, source with language, and the size in half powers of two; nulls have buckets too."""
    source, lang = batch.column("source").to_pylist(), batch.column("lang").to_pylist()
    chars = batch.column("n_chars").to_pylist()
    out = np.zeros((batch.num_rows, META_DIMS), dtype=np.float32)
    for i, (s, g, n) in enumerate(zip(source, lang, chars, strict=True)):
        size = -1 if n is None or n < 0 else int(2 * np.log2(n + 1))
        for part in (f"s{s!r}", f"l{g!r}", f"b{s!r}{g!r}", f"n{size}"):
            out[i, zlib.crc32(part.encode(errors="replace")) % META_DIMS] += 0.5
    return out


def features(batch: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([text_features(batch.column("text")), meta_features(batch)], axis=1)


_VIEWS = (slice(0, TEXT_DIMS), slice(TEXT_DIMS, TEXT_DIMS + META_DIMS))


@dataclass
class Model:
    views: list[tuple[np.ndarray, float]]
    platt: list[tuple[float, float]]
    join: tuple[np.ndarray, float]

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds of both views."""
        return np.stack([a * (x[:, v] @ w + b) + c for v, (w, b), (a, c) in zip(_VIEWS, self.views, self.platt, strict=True)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return learning.sigmoid(self.odds(x) @ self.join[0] + self.join[1])


Views = list[tuple[np.ndarray, float]]


@dataclass
class Handed:
    """What a view has been handed: rows and summed features, by label and group."""

    n: np.ndarray
    total: np.ndarray

    @classmethod
    def none(cls, view: slice) -> Handed:
        return cls(np.zeros((2, GROUPS)), np.zeros((2, GROUPS, view.stop - view.start)))


def sure_from(x: np.ndarray, y: np.ndarray, views: Views) -> list[tuple[float, float]]:
    """For each view the margins below which it is sure of label 0, and above which of label 1: the middle ones of the labelled rows."""
    out = []
    for v, (w, b) in zip(_VIEWS, views, strict=True):
        z = x[:, v] @ w + b
        out.append((min(float(np.median(z[y == 0])), 0.0), max(float(np.median(z[y == 1])), 0.0)))
    return out


def learned(x: np.ndarray, y: np.ndarray, handed: list[Handed]) -> Views:
    """Weights and bias of both views from the labelled rows and the means of what they have been handed."""
    views = []
    for v, given in zip(_VIEWS, handed, strict=True):
        xs, ys, weight = [x[:, v]], [y], [np.ones(len(y))]
        for label in (0, 1):
            has = np.flatnonzero(given.n[label])
            if len(has):
                n = given.n[label][has]
                xs.append((given.total[label][has] / n[:, None]).astype(np.float32))
                ys.append(np.full(len(has), label, dtype=np.float32))
                weight.append(HANDED * (y == label).sum() * n / n.sum())
        views.append(learning.fit_logistic(np.concatenate(xs), np.concatenate(ys), np.concatenate(weight)))
    return views


def _handover(shared):
    """For each view, label and group the number and the summed features of the rows that the *other* view is sure of; dim -1 is the number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, sure = shared.value
        handed = [Handed.none(v) for v in _VIEWS]
        for batch in batches:
            x, group = features(batch), batch.column("grp").to_numpy()
            for k, (v, (w, b), (low, high)) in enumerate(zip(_VIEWS, views, sure, strict=True)):
                z = x[:, v] @ w + b
                for label, at in ((0, np.flatnonzero(z <= low)), (1, np.flatnonzero(z >= high))):
                    given, own = handed[1 - k], np.zeros((GROUPS, len(at)))
                    own[group[at], np.arange(len(at))] = 1
                    given.n[label] += own.sum(axis=1)
                    given.total[label] += own @ np.rint(x[at][:, _VIEWS[1 - k]].astype(np.float64) * _UNIT)
        for k, given in enumerate(handed):
            for label in (0, 1):
                both = np.concatenate([given.n[label][:, None], given.total[label]], axis=1).astype(np.int64)
                grp, dim = np.nonzero(both)
                yield pa.record_batch([pa.array(np.full(len(grp), k, np.int32)), pa.array(np.full(len(grp), label, np.int32)), pa.array(grp.astype(np.int32)), pa.array(dim.astype(np.int32) - 1), pa.array(both[grp, dim])], names=["view", "label", "grp", "dim", "value"])

    return run


def hand_over(rows: DataFrame, views: Views, sure: list[tuple[float, float]], handed: list[Handed]) -> None:
    """Add to ``handed`` what the views hand each other of ``rows`` (text, lang, source, n_chars, grp): some 70,000 numbers, whatever the data."""
    shared = rows.sparkSession.sparkContext.broadcast((views, sure))
    found = rows.mapInArrow(_handover(shared), "view int, label int, grp int, dim int, value long").groupBy("view", "label", "grp", "dim").agg(F.sum("value").alias("value")).toArrow()
    view, label, grp, dim, value = (found.column(c).to_numpy() for c in ("view", "label", "grp", "dim", "value"))
    for k, given in enumerate(handed):
        at = (view == k) & (dim < 0)
        given.n[label[at], grp[at]] += value[at]
        at = (view == k) & (dim >= 0)
        given.total[label[at], grp[at], dim[at]] += value[at] / _UNIT


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model | None:
    """Both views from a bounded sample of the labelled rows of ``docs`` and from all its rows; None with fewer than two labels.

    Of several labels of a document the smallest counts; null labels are left out.
    Rows that have a label are handed over like any others, by what the views say.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select("doc_id", "text", "lang", "source", "n_chars")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = learning.stratified(known, "quality", sample)
    shape = learning.featurise(features, ["doc_id", "quality"])
    table, x = learning.collected(slim.join(F.broadcast(chosen), "doc_id").mapInArrow(shape, "doc_id long, quality int, x binary"))
    y = table.column("quality").to_numpy().astype(np.float32)
    if len(set(y.tolist())) < 2:
        return None
    totals = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    apart = tk.splitmix(table.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(4) == 0
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart[:] = False
    train, test = ~apart, apart if apart.any() else ~apart
    handed = [Handed.none(v) for v in _VIEWS]
    views = learned(x[train], y[train], handed)
    place = F.xxhash64("text", "doc_id")
    for r in range(rounds):
        rows = slim.where(F.pmod(place, F.lit(rounds)) == r).select("text", "lang", "source", "n_chars", F.pmod(F.shiftright(place, 20), F.lit(GROUPS)).cast("int").alias("grp"))
        hand_over(rows, views, sure_from(x[train], y[train], views), handed)
        views = learned(x[train], y[train], handed)
    weight = np.array([totals[int(v)] / max(1, (y == v).sum()) for v in y])[test]
    platt = [learning.fit_platt(x[test][:, v] @ w + b, y[test], weight) for v, (w, b) in zip(_VIEWS, views, strict=True)]
    model = Model(views, platt, (np.zeros(2), 0.0))
    odds = model.odds(x[test]).astype(np.float32)
    model.join = learning.fit_logistic(odds, y[test], weight, ridge=1e-3, steps=500)
    return model


def annotate(docs: DataFrame, model: Model | None, score: str = "score") -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars and more) with the score in a free column of this name; 1 without a model."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some KB, whatever the data

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        p = np.ones(batch.num_rows) if shared.value is None else shared.value.score(features(batch))
        return [pa.array(p.astype(np.float64), pa.float64())]

    return learning.appended(docs, f"`{score}` double", make)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that labels may be learned from: crc32(doc_id as text) mod 4 is not 2."""
    return docs.where(learning.fold(F.col("doc_id"), 4) != 2)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source, n_chars): doc_id, held_out, score, kept (score >= 0.5), predicted.

    score is the probability of quality 1; held_out marks rows whose crc32(doc_id
    as text) mod 4 is 2, which nothing is learned from.

    Null and empty texts have no n-grams, null metadata has buckets of its own, so
    every row gets a score.  A null doc_id is neither held out nor learned from.
    Repeated rows get equal scores.  With no labels, or only one, all scores are 1
    and every row is kept.  Extra columns are not read.
    """
    model = fit(learnable(docs), labels)
    held = docs.select("doc_id", F.coalesce(learning.fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "text", "lang", "source", "n_chars")
    good = F.col("score") >= THRESHOLD
    return annotate(held, model).select("doc_id", "held_out", "score", good.alias("kept"), good.cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``; columns as they were.

    Null and empty texts are scored like others, repeated rows go on or out together,
    and with no labels, or only one, every row goes on.
    """
    score = fresh(docs, "quality_score")
    return annotate(docs, fit(learnable(docs), labels), score).where(F.col(score) >= threshold).drop(score)
