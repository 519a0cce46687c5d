"""Toxicity scores from a convolutional text classifier trained in numpy.

Words, and their first and last bytes, are hashed into an embedding table; filters of several widths run over the
whole text, each keeps its largest response, and a logistic layer reads these.
Training takes all labelled rows, in shards, with Adagrad: in each round every shard goes
on from the same network through its own rows, and what they changed is averaged, an
embedding's over the shards that have its words.  The
gradients touch only the places where a filter has its maximum.  The first number of
every embedding starts as the evidence of its words for the label, so that few rows
are enough to find the words that tell.  Each language,
as predicted from the text, has a calibration of its own, made on all labelled rows
apart from training, in which the threshold with the best F1 becomes 0.3.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebeam.llm import langid, learning
from sagebeam.llm import textkit as tk
from sagebeam.llm.frames import BROADCAST_ROWS, bounded_batches, discard, fresh, stored

BUCKETS = 1 << 15
SIZE, FILTERS, WIDTHS = 16, 24, (1, 2, 3)
#: Labelled rows of a shard that is trained on, about; fewer rows are one shard.
SHARD = 4096
#: Steps of a margin's grid, by which the calibrations count rows, and its limits.
_STEPS, _FAR = 256, 128
EPOCHS = 5
_BATCH = 32
THRESHOLD = 0.3
#: Languages with fewer calibration rows of either label use the calibration of all.
_LEAST = 20
_CHUNK = 1 << 14
_HEAD, _TAIL, PIECES = 4, 4, 3
_RATE, _CAUTION, _DROP = 0.1, 1e-3, 0.2
#: Standard deviations of evidence that an embedding starts with as 1.
_SIGMAS = 4.0
#: Few rows are gone through more often, to about so many rows in all.
_LEAST_ROWS, _MOST_EPOCHS = 20_000, 30
_PAD = max(WIDTHS) - 1


def word_numbers(words: tk.Words) -> np.ndarray:
    """Three buckets for every word, from 1: of the whole, of its first and of its last bytes; 0 is the padding."""
    pieces = (words.hashes(), tk.mixed(words.hashes(head=_HEAD), 1), tk.mixed(words.hashes(tail=_TAIL), 2))
    return np.stack([(p % np.uint64(BUCKETS - 1)).astype(np.int32) + 1 for p in pieces], axis=1)


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by padding, and where each begins."""
    gap = np.zeros((_PAD, PIECES), dtype=np.int32)
    sizes = np.array([len(t) + _PAD for t in texts])
    line = np.concatenate([p for t in texts for p in (t, gap)] + [gap])
    return line, np.concatenate([[0], np.cumsum(sizes)[:-1]])


@dataclass
class Network:
    table: np.ndarray  # BUCKETS x SIZE
    filters: list[np.ndarray]  # for each width: width x SIZE x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    @classmethod
    def initial(cls, evidence: np.ndarray, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
        table[:, 0] = np.clip(evidence / _SIGMAS, -1.5, 1.5)
        table[0] = 0
        filters = [rng.normal(0, (w * SIZE) ** -0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[:, 0] = np.abs(f[:, 0])  # every filter starts by looking for evidence
        n = FILTERS * len(WIDTHS)
        return cls(table, filters, np.zeros(n, dtype=np.float32), rng.normal(0, n**-0.5, n).astype(np.float32), 0.0)

    def pooled(self, line: np.ndarray, begins: np.ndarray, places: bool = False):
        """The largest response of each filter in each text, not below 0; with ``places`` also where it is."""
        n = len(line) - _PAD
        vectors = self.table[line[:, 0]]
        for k in range(1, PIECES):
            vectors += self.table[line[:, k]]
        top, where = [], []
        for f in self.filters:
            z = vectors[:n] @ f[0]
            for k in range(1, len(f)):
                z += vectors[k : n + k] @ f[k]
            top.append(np.maximum.reduceat(z, begins, axis=0))
            if places:
                ends = np.append(begins[1:], n)
                where.append(np.stack([b + z[b:e].argmax(axis=0) for b, e in zip(begins, ends, strict=True)]))
        h = np.concatenate(top, axis=1) + self.bias
        return (np.maximum(h, 0), h > 0, np.concatenate(where, axis=1), vectors) if places else np.maximum(h, 0)

    def margins(self, texts: list[np.ndarray]) -> np.ndarray:
        """The logits of texts; long lists are worked through in pieces, and long texts in overlapping ones."""
        h = np.zeros((len(texts), len(self.bias)), dtype=np.float32)
        pieces, owners, held = [], [], 0

        def flush() -> None:
            nonlocal pieces, owners, held
            if pieces:
                np.maximum.at(h, owners, self.pooled(*padded(pieces)))
            pieces, owners, held = [], [], 0

        for i, t in enumerate(texts):
            for at in range(0, max(1, len(t)), _CHUNK):
                part = t[at : at + _CHUNK + _PAD]
                pieces.append(part), owners.append(i)
                held += len(part) + _PAD
                if held >= _CHUNK:
                    flush()
        flush()
        return h @ self.out + self.out_bias


def found_in(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """By label and bucket the number of the texts that have it."""
    has = np.zeros((2, BUCKETS))
    for t, label in zip(texts, y, strict=True):
        has[int(label), np.unique(t)] += 1
    return has


def evidence(has: np.ndarray, total: np.ndarray) -> np.ndarray:
    """For each bucket the log odds ratio of the texts that have it, by label, in standard deviations; 0 for one that no text has."""
    total = total[:, None]
    odds = np.log((has + 0.5) / (total - has + 0.5))
    return np.where(has.sum(axis=0) > 0, (odds[1] - odds[0]) / np.sqrt((1 / (has + 0.5)).sum(axis=0)), 0)


@dataclass
class Learner:
    """A network and, place by place, Adagrad's sums of its squared gradients."""

    net: Network
    sums: Network

    @classmethod
    def initial(cls, evidence: np.ndarray, seed: int = 1) -> Learner:
        net = Network.initial(evidence, seed)
        start = lambda v: np.full_like(v, _CAUTION)
        return cls(net, Network(start(net.table), [start(f) for f in net.filters], start(net.bias), start(net.out), _CAUTION))

    def copy(self) -> Learner:
        return Learner(*(Network(n.table.copy(), [f.copy() for f in n.filters], n.bias.copy(), n.out.copy(), n.out_bias) for n in (self.net, self.sums)))

    def tables(self) -> np.ndarray:
        """The embeddings and their sums, a row a bucket."""
        return np.concatenate([self.net.table, self.sums.table], axis=1)

    def rest(self) -> np.ndarray:
        """All else in one line."""
        return np.concatenate([v for n in (self.net, self.sums) for v in (*(f.ravel() for f in n.filters), n.bias, n.out, [n.out_bias])])

    def add(self, tables: np.ndarray, rest: np.ndarray) -> None:
        """Add to ``tables()`` and to ``rest()``."""
        self.net.table += tables[:, :SIZE].astype(np.float32)
        self.sums.table += tables[:, SIZE:].astype(np.float32)
        at = 0
        for n in (self.net, self.sums):
            for v in (*n.filters, n.bias, n.out):
                v += rest[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size
            n.out_bias += float(rest[at])
            at += 1

    def train(self, texts: list[np.ndarray], y: np.ndarray, epochs: int, seed: int | list[int] = 1) -> None:
        net, sums, rng = self.net, self.sums, np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), _BATCH):
                own = order[at : at + _BATCH]
                line, begins = padded([texts[i] for i in own])
                line = np.where(rng.random(line.shape) < _DROP, 0, line)  # some pieces are left out, so that no single one is relied on
                words, numbers = np.unique(line, return_inverse=True)
                numbers = numbers.reshape(line.shape)
                small = Network(net.table[words], net.filters, net.bias, net.out, net.out_bias)
                h, live, where, vectors = small.pooled(numbers, begins, places=True)
                error = (learning.sigmoid(h @ net.out + net.out_bias) - y[own]).astype(np.float32) / len(own)
                back = error[:, None] * net.out * live
                g_out, g_out_bias, g_bias = h.T @ error + 1e-5 * net.out, float(error.sum()), back.sum(axis=0)
                g_table = np.zeros((len(words), SIZE), dtype=np.float32)
                for w, f in enumerate(net.filters):
                    cut = slice(w * FILTERS, (w + 1) * FILTERS)
                    d, p = back[:, cut], where[:, cut]
                    g = np.zeros_like(f)
                    for k in range(len(f)):
                        g[k] = np.einsum("bf,bfs->sf", d, vectors[p + k])
                        down = d[:, :, None] * f[k].T[None]
                        for piece in range(PIECES):
                            np.add.at(g_table, numbers[p + k, piece], down)
                    sums.filters[w] += g * g
                    f -= _RATE * g / np.sqrt(sums.filters[w])
                g_table[words == 0] = 0
                sums.table[words] += g_table * g_table
                net.table[words] -= _RATE * g_table / np.sqrt(sums.table[words])
                for name, g in (("bias", g_bias), ("out", g_out)):
                    held = getattr(sums, name)
                    held += g * g
                    getattr(net, name)[...] -= _RATE * g / np.sqrt(held)
                sums.out_bias += g_out_bias**2
                net.out_bias -= _RATE * g_out_bias / sums.out_bias**0.5


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """A network from texts that are one shard."""
    learner = Learner.initial(evidence(found_in(texts, y), np.array([(y == 0).sum(), (y == 1).sum()])), seed)
    learner.train(texts, y, epochs, seed)
    return learner.net


_BLOCK = 512


def _vectors(shard: int, tables: np.ndarray, weights: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
    """What a task's shards changed, by blocks of buckets, for ``learning.summed``: sums over shards times their rows, and these rows."""
    both = np.concatenate([tables, weights[:, None]], axis=1).astype(np.float32)
    blocks = [(str(at // _BLOCK), b) for at in range(0, BUCKETS, _BLOCK) if (b := both[at : at + _BLOCK])[:, -1].any()]
    keys, values = zip(*blocks, ("rest", rest.astype(np.float32)), strict=True)
    return pa.record_batch([pa.array(keys), pa.array([shard] * len(keys), pa.int32()), pa.array([v.tobytes() for v in values], pa.binary())], names=["key", "shard", "x"])


def _shard(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray]:
    return [np.frombuffer(r["x"], dtype=np.uint16).reshape(-1, PIECES) for r in rows], np.array([r["toxic"] for r in rows], dtype=np.float32)


def _counts(shards: DataFrame) -> np.ndarray:
    """By label and bucket the number of texts that have it, over all shards, copies left out."""

    def run(batches):
        for batch in batches:
            for number, rows in zip(batch.column("shard").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                has = found_in(*_shard([r for r in rows if not r["copy"]]))
                # Of 32-bit floats: exact, as a shard's counts and sums of 2^24 of them are.
                yield pa.record_batch([pa.array(["has"]), pa.array([number], pa.int32()), pa.array([has.astype(np.float32).tobytes()], pa.binary())], names=["key", "shard", "x"])

    return learning.summed(shards.mapInArrow(run, learning.VECTOR))["has"].reshape(2, BUCKETS)


def _round(shards: DataFrame, learner: Learner, epochs: int, number: int) -> None:
    """Every shard goes on from ``learner``; the mean of what they changed, by their rows, is added to it."""
    shared = shards.sparkSession.sparkContext.broadcast(learner)  # about 4 MB, whatever the data

    def run(batches):
        first, tables, weights, rest = None, np.zeros((BUCKETS, 2 * SIZE)), np.zeros(BUCKETS), np.zeros(len(shared.value.rest()) + 1)
        before, other = shared.value.tables(), shared.value.rest()
        for batch in batches:
            for shard, rows in zip(batch.column("shard").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                texts, y = _shard(rows)
                own = shared.value.copy()
                # A single shard is gone through like the texts of ``train``.
                own.train(texts, y, epochs, [number, shard] if number else 1)
                words = np.unique(np.concatenate([t.ravel() for t in texts]))
                tables[words] += len(y) * (own.tables()[words].astype(np.float64) - before[words])
                weights[words] += len(y)
                rest += len(y) * np.append(own.rest() - other, 1)
                first = shard if first is None else min(first, shard)
        if first is not None:
            yield _vectors(first, tables, weights, rest)

    sums = learning.summed(shards.mapInArrow(run, learning.VECTOR))
    shared.destroy()
    rest, tables = sums.pop("rest"), np.zeros((BUCKETS, 2 * SIZE))
    for block, x in sums.items():
        x = x.reshape(-1, 2 * SIZE + 1)
        tables[int(block) * _BLOCK : (int(block) + 1) * _BLOCK] = x[:, :-1] / np.maximum(x[:, -1:], 1)
    learner.add(tables, rest[:-1] / rest[-1])


def _calibration(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Platt, moved so that the margin with the best weighted F1 has the score THRESHOLD."""
    a, _ = learning.fit_platt(z, y, weight)
    a = max(a, 0.05)
    order = np.argsort(-z, kind="stable")
    hit, n = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (n + (weight * y).sum())
    best = int(np.flatnonzero(f1 >= f1.max() - 1e-12).mean())
    cut = float((z[order][best] + z[order][min(best + 1, len(z) - 1)]) / 2)
    return a, float(np.log(THRESHOLD / (1 - THRESHOLD)) - a * cut)


@dataclass
class Model:
    network: Network
    languages: langid.Model | None
    calibrations: dict[str, tuple[float, float]]  # "" for all other languages

    def margins(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The network's margins and the predicted languages."""
        z = np.zeros(len(texts))
        for words in tk.words(texts, tk.ALNUM):
            number = word_numbers(words)
            z[words.lo : words.hi] = self.network.margins([number[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)])
        return z, langid.guess(self.languages, texts)[0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        z, lang = self.margins(texts)
        fits = np.array([self.calibrations.get(v, self.calibrations[""]) for v in lang]).reshape(-1, 2)
        return learning.sigmoid(fits[:, 0] * z + fits[:, 1])


def _apart(ids: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Which rows calibrate: a quarter, by a hash of their ids."""
    return tk.splitmix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(4) == 0


def _numbered(batches):
    """(doc_id, toxic, apart, x) with the numbers of the words of (doc_id, text, toxic)."""
    for batch in batches:
        out = []
        for words in tk.words(batch.column("text"), tk.ALNUM):
            n = word_numbers(words)
            out += [n[a:b].astype(np.uint16).tobytes() for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(_apart(batch.column("doc_id"))), pa.array(out, pa.binary())], names=["doc_id", "toxic", "apart", "x"])


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, and what more columns of ``docs``) of the rows that have a label; few labels are broadcast, so that texts need no shuffle."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(known) if few else known, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, size: int = SHARD, epochs: int = EPOCHS) -> Model | None:
    """A model from all labelled rows of ``docs`` (doc_id, text, lang); three quarters train, in shards of about ``size``, the rest calibrate.

    Of so few rows that a part would lack a label, all do both.  None where no row, or only one label, is known.  Rows of ``labels`` with a null
    label are left out; of several for a document the largest counts.
    """
    bounded_batches(docs.sparkSession)

    def parts(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("toxic"), pa.array(_apart(batch.column("doc_id")))], names=["toxic", "apart"])

    n = {(r["apart"], r["toxic"]): r["n"] for r in _labelled(docs.select("doc_id"), labels).select("doc_id", "toxic").mapInArrow(parts, "toxic int, apart boolean").groupBy("toxic", "apart").agg(F.count("*").alias("n")).collect()}
    totals = {v: n.get((False, v), 0) + n.get((True, v), 0) for _, v in n}
    if len(totals) < 2:
        return None
    # Where a part would lack a label, all rows do both.
    whole = min(len({v for a, v in n if a == part}) for part in (False, True)) < 2
    trained = totals if whole else {v: k for (a, v), k in n.items() if not a}
    rows = _labelled(docs.select("doc_id", "text"), labels).select("doc_id", "text", "toxic")
    numbered = rows.mapInArrow(_numbered, "doc_id long, toxic int, apart boolean, x binary").where("true" if whole else "not apart")
    shards = learning.dealt(numbered.drop("apart"), "toxic", trained, size).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("doc_id", "x", "toxic", "copy"))).alias("rows"))
    shards, path = stored(shards, "toxicity-shards")
    learner = Learner.initial(evidence(_counts(shards), np.array([trained[0], trained[1]])))
    if round(sum(trained.values()) / size) <= 1:
        _round(shards, learner, max(epochs, min(_MOST_EPOCHS, _LEAST_ROWS // sum(totals.values()))), 0)
    else:
        for number in range(1, epochs + 1):
            _round(shards, learner, 1, number)
    discard(docs.sparkSession, path)
    model = Model(learner.net, langid.fit(docs), {"": (1.0, 0.0)})
    model.calibrations = _calibrations(rows, model, whole)
    return model


def _calibrations(rows: DataFrame, model: Model, whole: bool) -> dict[str, tuple[float, float]]:
    """Calibrations by predicted language, from the margins of all rows apart (all rows, with ``whole``), counted on a grid."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def margins(batches):
        for batch in batches:
            own = batch if whole else batch.filter(pa.array(_apart(batch.column("doc_id"))))
            if not own.num_rows:
                continue
            z, lang = shared.value.margins(own.column("text"))
            place = np.rint(np.clip(z, -_FAR, _FAR) * _STEPS).astype(np.int32)
            yield pa.record_batch([pa.array(lang.tolist(), pa.string()), pa.array(place), own.column("toxic")], names=["lang", "place", "toxic"])

    counted = rows.mapInArrow(margins, "lang string, place int, toxic int").groupBy("lang", "place").agg(F.count("*").alias("n"), F.sum("toxic").alias("hit"))
    found = counted.toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])  # at most a row for each language and step
    lang = np.array(found.column("lang").to_pylist(), dtype=object)
    z, n, hit = (found.column(c).to_numpy().astype(np.float64) for c in ("place", "n", "hit"))
    z, y = z / _STEPS, hit / n
    out = {}
    for name in ("", *sorted(set(lang))):
        at = lang == name if name else np.ones(len(z), dtype=bool)
        if not name or min(hit[at].sum(), (n - hit)[at].sum()) >= _LEAST:
            out[name] = _calibration(z[at], y[at], n[at])
    return out


def annotate(docs: DataFrame, model: Model | None, score: str = "score") -> DataFrame:
    """``docs`` with the score in a column of this name, which must be free; without a model all scores are 0."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 2 MB of embeddings, whatever the data

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        if shared.value is None:
            return [pa.array(np.zeros(batch.num_rows), pa.float64())]
        return [pa.array(shared.value.scores(batch.column("text")), pa.float64())]

    return learning.appended(docs, f"`{score}` double", make)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that labels may be learned from: crc32(doc_id as text) mod 4 is not 2."""
    return docs.where(learning.fold(F.col("doc_id"), 4) != 2)


def toxic(docs: DataFrame, labels: DataFrame, size: int = SHARD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, score, predicted (score >= 0.3).

    held_out marks rows whose crc32(doc_id as text) mod 4 is 2.  ``labels``
    (doc_id, toxic 0/1) and languages are learned from other rows only; scores
    come from the text alone.

    Null and empty texts have no words and get the score of an empty text.  A null
    doc_id is neither held out nor learned from.  Repeated rows get equal scores.
    With no labels, or only one, all scores are 0.  Extra columns are not read.
    """
    model = fit(learnable(docs), labels, size)
    held = docs.select("doc_id", F.coalesce(learning.fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "text")
    return annotate(held, model).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``; columns as they were.

    Null and empty texts have the score of an empty text, repeated rows go on or out
    together, and with no labels, or only one, every row goes on.
    """
    score = fresh(docs, "toxic_score")
    out = annotate(docs, fit(learnable(docs), labels), score)
    return out.where(F.col(score) < threshold).drop(score)
