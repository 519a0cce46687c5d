"""Language identification in two steps: the language's family, then the language within it.

Both steps are one-versus-one linear support vector machines over hashed byte
n-grams of the whole text, trained in numpy on shards of all labelled rows, whose
weights are then averaged; each machine's margin is calibrated to a probability.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebeam.llm import learning
from sagebeam.llm.frames import bounded_batches, fresh

DIMS = 2048
#: Labelled rows of a shard, about; fewer rows are one shard.
SHARD = 3000

# Families of languages by ISO 639-1 code; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "uralic": ("et", "fi", "hu"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
UNKNOWN = "und"


def family(lang: str) -> str:
    return _FAMILY.get(lang, f"only {lang}")


@dataclass
class Duels:
    """One-versus-one machines of some classes."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # a column a pair
    bias: np.ndarray
    platt: np.ndarray  # slope and offset a pair

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Duels:
        classes = sorted(set(labels))
        pairs = list(combinations(range(len(classes)), 2))
        weights, bias, platt = np.zeros((x.shape[1], len(pairs)), dtype=np.float32), np.zeros(len(pairs)), np.zeros((len(pairs), 2))
        for k, (i, j) in enumerate(pairs):
            at = np.isin(labels, [classes[i], classes[j]])
            y = np.where(labels[at] == classes[i], 1.0, -1.0).astype(np.float32)
            own = x if at.all() else x[at]
            weights[:, k], bias[k] = learning.fit_svm(own, y)
            z = own @ weights[:, k] + bias[k]
            platt[k] = learning.fit_platt(z, y > 0)
        return cls(classes, pairs, weights, bias, platt)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers and probabilities: most duels won, ties by the sum of probabilities; the winner's least probable duel."""
        if not self.pairs:
            return np.zeros(len(x), dtype=int), np.ones(len(x))
        p = learning.sigmoid((x @ self.weights + self.bias) * self.platt[:, 0] + self.platt[:, 1])
        won, least = np.zeros((len(x), len(self.classes))), np.ones((len(x), len(self.classes)))
        for k, (i, j) in enumerate(self.pairs):
            won[:, i] += (p[:, k] >= 0.5) + 1e-3 * p[:, k]
            won[:, j] += (p[:, k] < 0.5) + 1e-3 * (1 - p[:, k])
            least[:, i], least[:, j] = np.minimum(least[:, i], p[:, k]), np.minimum(least[:, j], 1 - p[:, k])
        best = won.argmax(axis=1)
        return best, least[np.arange(len(x)), best]


@dataclass
class Model:
    families: Duels
    within: dict[str, Duels]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, score = self.families.decide(x)
        lang = np.empty(len(x), dtype=object)
        score = score.copy()
        for f, name in enumerate(self.families.classes):
            at = np.flatnonzero(first == f)
            best, p = self.within[name].decide(x[at])
            lang[at] = np.array(self.within[name].classes, dtype=object)[best]
            score[at] *= p
        return lang, score


def features(texts: pa.ChunkedArray) -> np.ndarray:
    out, at = np.zeros((len(texts), DIMS), dtype=np.float32), 0
    for chunk in texts.chunks:
        for a, b, x in learning.ngrams(chunk, learning.LETTERS, DIMS):
            out[at + a : at + b] = x
        at += len(chunk)
    return out


def _machines(model: Model, shard: int, families: Counter, languages: Counter) -> Iterator[tuple[str, int, bytes]]:
    """(key, shard, vector) of a shard's machines: weights, bias, slope and offset, times the rows they were trained on, and these rows."""
    for name, duels, counts in [("", model.families, families), *((name, duels, languages) for name, duels in model.within.items())]:
        for k, (i, j) in enumerate(duels.pairs):
            a, b = duels.classes[i], duels.classes[j]
            n = counts[a] + counts[b]
            yield json.dumps([name, a, b]), shard, (n * np.concatenate([duels.weights[:, k], [duels.bias[k]], duels.platt[k], [1]])).astype(np.float32).tobytes()


def _joined(classes: list[str], name: str, sums: dict[str, np.ndarray]) -> Duels:
    """The machines of some classes, each the mean of its shards'."""
    pairs = list(combinations(range(len(classes)), 2))
    means = np.zeros((len(pairs), DIMS + 4))
    for k, (i, j) in enumerate(pairs):
        found = sums.get(json.dumps([name, classes[i], classes[j]]))  # none where no shard has both, as of rows that share a doc_id
        means[k] = 0 if found is None else found / found[-1]
    return Duels(classes, pairs, np.ascontiguousarray(means[:, :DIMS].T, dtype=np.float32), means[:, DIMS], means[:, DIMS + 1 : DIMS + 3])


def fit(rows: DataFrame, size: int = SHARD) -> Model | None:
    """Machines trained on all ``rows`` (doc_id, text, lang) that have both a text and a language; None without any.

    Shards of about ``size`` rows train machines of their own, each a group of one
    task; a machine is the mean of those of all shards.
    """
    bounded_batches(rows.sparkSession)
    known = rows.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    if not counts:
        return None

    def learn(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        x = features(shard.column("text"))
        labels = np.array(shard.column("lang").to_pylist(), dtype=object)
        groups = np.array([family(v) for v in labels], dtype=object)
        model = Model(Duels.fit(x, groups), {g: Duels.fit(x[groups == g], labels[groups == g]) for g in sorted(set(groups))})
        found = list(_machines(model, shard.column("shard")[0].as_py(), Counter(groups), Counter(labels)))
        return pa.table([pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.binary()))], names=["key", "shard", "x"])

    sums = learning.summed(learning.dealt(known, "lang", counts, size).groupBy("shard").applyInArrow(learn, learning.VECTOR))
    groups = sorted({family(v) for v in counts})
    return Model(_joined(groups, "", sums), {g: _joined([v for v in sorted(counts) if family(v) == g], g, sums) for g in groups})


def _lettered(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    ascii_ = pc.match_substring_regex(texts, "[A-Za-z]").to_numpy(zero_copy_only=False)
    out = np.array([bool(v) for v in ascii_])
    for i in np.flatnonzero(~out):
        text = texts[int(i)].as_py()
        out[i] = bool(text) and any(c.isalpha() for c in text)
    return out


def guess(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Languages and scores of a column of texts."""
    lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
    if model is None:
        return lang, score
    at = 0
    for a, b, x in learning.ngrams(texts, learning.LETTERS, DIMS):
        lang[a:b], score[a:b] = model.predict(x)
        at = b
    none = ~_lettered(texts)
    lang[none], score[none] = UNKNOWN, 0.0
    return lang[: max(at, len(texts))], score


def annotate(docs: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score in columns of these names, which must be free."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred KB, by DIMS and the number of pairs

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found, p = guess(shared.value, batch.column("text"))
        return [pa.array(found.tolist(), pa.string()), pa.array(p, pa.float64())]

    return learning.appended(docs, f"`{lang}` string, `{score}` double", make)


def identify(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    held_out marks rows whose crc32(doc_id as text) mod 5 is 0; the others that
    have a lang are trained on, in shards of about ``size``.  lang_pred is a learned lang, or
    "und" (score 0) if the text is null, empty or has no letter, or if nothing
    could be learned.  score is the product of the family's and the language's
    probability.

    A null doc_id is neither held out nor learned from.  Repeated rows and extra
    columns change nothing; whole texts are read, whatever their length.
    """
    fold = learning.fold(F.col("doc_id"), 5)
    model = fit(docs.where(fold != 0), size)
    held = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")
    return annotate(held, model).drop("text").select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.0, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is known (with at least ``least_score``, among ``languages`` if given); columns as they were.

    Null and empty texts and those without a letter go, repeated rows go on or out
    together, and without any labelled row none goes on.
    """
    model = fit(docs.where(learning.fold(F.col("doc_id"), 5) != 0))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    out = annotate(docs, model, lang, score)
    good = (F.col(lang) != UNKNOWN) & (F.col(score) >= least_score)
    if languages is not None:
        good = good & F.col(lang).isin(*languages)
    return out.where(good).drop(lang, score)
