"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one task.  Its text is a sequence of word
numbers over the vocabulary of the test phrases: a word outside it cannot be
part of an occurrence, so it ends a run, and runs shorter than the shortest
phrase are left out.  The suffix array comes from prefix doubling in numpy, the
Burrows-Wheeler transform is held as a wavelet matrix with rank counts, all
phrases are searched backwards at once, and rows are turned into positions by
walking back to a sampled suffix.  Occurrences become spans of words and bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebeam.llm import textkit as tk
from sagebeam.llm.frames import bounded_batches, discard, fresh, stored

WINDOW = 10
#: Word numbers that one index holds; a longer document makes an index of its own.
SHARD_WORDS = 1 << 20
#: Phrases that one pass broadcasts, at most about 8 MB; more phrases take more passes.
BLOCK_PHRASES = 100_000
_SAMPLE = 8
_BREAK = 0
#: Tasks that rows with the same phrases are dealt to.
SALTS = 16


class WaveletMatrix:
    """Rank over an integer sequence: one bit vector a level, most significant bit first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ranks, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at``, for arrays of both."""
        start, end = np.zeros_like(at), at
        for ones, zeros, level in zip(self.ranks, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            s, e = ones[start], ones[end]
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ranks, self.zeros, strict=True):
            one = ones[at + 1] - ones[at]
            out = out * 2 + one
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order; every break is smaller than any word and than any later break, so no comparison passes one."""
    n = len(text)
    breaks = text == _BREAK
    rank = np.where(breaks, np.cumsum(breaks) - 1, text.astype(np.int64) + int(breaks.sum()))
    order = np.argsort(rank, kind="stable")
    active, step = None, 1
    while True:
        key = rank[order]
        first = np.ones(n, dtype=bool)
        first[1:] = key[1:] != key[:-1]
        if active is None:
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        alone = first.copy()
        alone[:-1] &= first[1:]
        active = np.flatnonzero(~alone)  # places of the order that are still tied
        if not len(active):
            return order
        where = order[active]
        after = np.where(where + step < n, rank[np.minimum(where + step, n - 1)], -1)
        by = np.lexsort((after, key[active]))
        order[active] = where[by]
        k, a = key[active], after[by]  # keys are sorted and stay in place
        new = np.ones(len(active), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (a[1:] != a[:-1])
        rank[order[active]] = np.maximum.accumulate(np.where(new, active, 0))
        step *= 2


class FMIndex:
    """Backward search and location in ``text``, runs of words (1..vocabulary) each ended by a 0."""

    def __init__(self, text: np.ndarray, vocabulary: int):
        order = suffix_array(text)
        self.vocabulary = vocabulary
        before = text[order - 1]  # the first suffix takes the last symbol, a break
        self.bwt = WaveletMatrix(before.astype(np.int32), max(1, int(vocabulary).bit_length()))
        counts = np.bincount(text, minlength=vocabulary + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        # Sampled: every few positions, and the start of each run, so that no walk crosses a break.
        sampled = (order % _SAMPLE == 0) | (before == _BREAK)
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo:hi whose suffixes begin with each phrase; phrases are right-aligned rows of word numbers."""
        width = phrases.shape[1]
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.first[-1], dtype=np.int64)
        for step in range(width):
            live = np.flatnonzero((step < lengths) & (lo < hi))
            symbol = phrases[live, width - 1 - step].astype(np.int64)
            lo[live] = self.first[symbol] + self.bwt.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.bwt.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of the suffixes of these rows."""
        rows, walked, out = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            done = self.sample_rank[at + 1] > self.sample_rank[at]
            out[left[done]] = self.samples[self.sample_rank[at[done]]] + walked[left[done]]
            left, at = left[~done], at[~done]
            symbol = self.bwt.access(at)
            rows[left] = self.first[symbol] + self.bwt.rank(symbol, at)
            walked[left] += 1
        return out


class Phrases:
    """Distinct phrases (rows of word hashes) with their keys and vocabulary."""

    def __init__(self, keys: np.ndarray, hashes: list[np.ndarray]):
        self.keys = keys
        self.lengths = np.array([len(h) for h in hashes], dtype=np.int64)
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, dtype=np.uint64)
        self.shortest = int(self.lengths.min()) if len(hashes) else 1
        self.rows = np.zeros((len(hashes), int(self.lengths.max()) if len(hashes) else 1), dtype=np.int64)
        for i, h in enumerate(hashes):
            self.rows[i, self.rows.shape[1] - len(h) :] = np.searchsorted(self.vocabulary, h) + 1
        self.known = np.zeros(1 << 16, dtype=bool)  # a first look by 16 bits of the hash
        self.known[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers from 1, or 0 for a word of no phrase."""
        out = np.zeros(len(hashes), dtype=np.int64)
        maybe = np.flatnonzero(self.known[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        found = self.vocabulary[at] == hashes[maybe]
        out[maybe[found]] = at[found] + 1
        return out


class _Shard:
    """Runs of phrase words of consecutive documents, waiting for an index."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.parts, self.docs, self.size = phrases, [], [], 0

    def add(self, words: tk.Words) -> None:
        number = self.phrases.numbers(words.hashes()) if len(self.phrases.keys) else np.zeros(len(words.starts), dtype=np.int64)
        hit = number > 0
        # A break follows the last word of each document, so runs end with documents.
        edge = np.zeros(len(hit) + 1, dtype=bool)
        edge[words.bounds] = True
        begins = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
        stops = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
        long = stops - begins >= self.phrases.shortest
        for a, b in zip(begins[long], stops[long], strict=True):
            doc = int(np.searchsorted(words.bounds, a, side="right")) - 1
            self.parts.append((len(self.docs) + doc, a - words.bounds[doc], number[a:b]))
            self.size += b - a + 1
        for r in range(words.hi - words.lo):
            a, b = words.bounds[r], words.bounds[r + 1]
            cut = words.cuts[r]
            self.docs.append((int(b - a), words.starts[a:b] - cut, words.ends[a:b] - cut))

    def found(self) -> Iterator[tuple[int, list[tuple[int, int, int, int]], np.ndarray]]:
        """For every document: words, merged spans (first word, end word, first byte, end byte), keys of its phrases."""
        spans: dict[int, list] = {}
        keys: dict[int, np.ndarray] = {}
        if self.parts:
            text = np.concatenate([np.concatenate([p[2], [_BREAK]]) for p in self.parts])
            sizes = np.array([len(p[2]) + 1 for p in self.parts])
            base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            index = FMIndex(text, len(self.phrases.vocabulary))
            lo, hi = index.search(self.phrases.rows, self.phrases.lengths)
            n = np.maximum(hi - lo, 0)
            which = np.repeat(np.arange(len(n)), n)
            at = index.locate(np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            depth = np.zeros(len(text) + 1, dtype=np.int64)
            np.add.at(depth, at, 1)
            np.add.at(depth, at + self.phrases.lengths[which], -1)
            covered = np.concatenate([[False], np.cumsum(depth[:-1]) > 0, [False]])
            begins, ends = np.flatnonzero(~covered[:-1] & covered[1:]), np.flatnonzero(covered[:-1] & ~covered[1:])
            part = np.searchsorted(base, begins, side="right") - 1
            for p, b, e in zip(part, begins, ends, strict=True):
                doc, first, _ = self.parts[p]
                _, starts, stops = self.docs[doc]
                x, y = int(first + b - base[p]), int(first + e - base[p])
                spans.setdefault(doc, []).append((x, y, int(starts[x]), int(stops[y - 1])))
            of = np.array([p[0] for p in self.parts])[np.searchsorted(base, at, side="right") - 1]
            pair = np.unique(np.stack([of, which]), axis=1) if len(of) else np.zeros((2, 0), dtype=np.int64)
            for doc in np.unique(pair[0]):
                keys[int(doc)] = self.phrases.keys[pair[1][pair[0] == doc]]
        for doc, (n_words, _, _) in enumerate(self.docs):
            yield n_words, spans.get(doc, []), keys.get(doc, np.zeros(0, dtype=np.int64))


_SPANS = "array<struct<first_word:long,end_word:long,first_byte:long,end_byte:long>>"
_SPAN = pa.list_(pa.struct([(k, pa.int64()) for k in ("first_word", "end_word", "first_byte", "end_byte")]))


def _searcher(shared, text: str, columns: list[str], names: list[str]):
    def flush(shard: _Shard, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(shard.found())
        at = 0
        for batch in batches:
            own = found[at : at + batch.num_rows]
            at += batch.num_rows
            spans = pa.array([[dict(zip(("first_word", "end_word", "first_byte", "end_byte"), s, strict=True)) for s in x[1]] for x in own], _SPAN)
            new = [pa.array([x[0] for x in own], pa.int64()), spans, pa.array([x[2].tolist() for x in own], pa.list_(pa.int64()))]
            yield pa.record_batch([*(batch.column(c) for c in columns), *new], names=[*columns, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(*shared.value)
        shard, waiting, held = _Shard(phrases), [], 0
        for batch in batches:
            for words in tk.words(batch.column(text), tk.ALNUM):
                shard.add(words)
            waiting.append(batch)
            held += batch.nbytes
            if shard.size >= SHARD_WORDS or held >= 1 << 24:
                yield from flush(shard, waiting)
                shard, waiting, held = _Shard(phrases), [], 0
        if waiting:
            yield from flush(shard, waiting)

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = [], []
        for words in tk.words(batch.column("text"), tk.ALNUM):
            h = words.hashes()
            for r, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:], strict=True)):
                own = [h[i : i + WINDOW].tobytes() for i in range(a, b - WINDOW + 1)] if b - a >= WINDOW else [h[a:b].tobytes()] if b > a else []
                ids += [words.lo + r] * len(own)
                out += own
        yield pa.record_batch([batch.column("item_id").take(pa.array(ids, pa.int64())), pa.array(out, pa.binary())], names=["item_id", "window"])


def phrase_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, window, phrase): every window of every item, phrase a 64-bit key of the window."""
    bounded_batches(benchmark.sparkSession)
    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.select("item_id", "text").mapInArrow(_windows, f"item_id {kind}, window binary")
    return stored(rows.withColumn("phrase", F.xxhash64("window")), "decontaminate-phrases")[0]


def annotate(docs: DataFrame, phrases: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with n_words, spans and phrases (names made fresh if taken), the names last; all rows and columns stay.

    spans are the merged places of all phrases in words and in UTF-8 bytes; phrases holds the keys found.
    Null and empty texts have none, repeated rows each have their own, and without any phrase all are empty.
    """
    spark = bounded_batches(docs.sparkSession)
    names = [fresh(docs, n) for n in ("n_words", "spans", "phrases")]
    blocks = max(1, math.ceil(phrases.select("phrase").distinct().count() / BLOCK_PHRASES))
    columns, out, passed = docs.columns, docs, []
    for block in range(blocks):
        own = phrases.where(F.pmod(F.col("phrase"), F.lit(blocks)) == block).select("phrase", "window").distinct().toArrow()
        shared = spark.sparkContext.broadcast((own.column("phrase").to_numpy(), [np.frombuffer(w, dtype=np.uint64) for w in own.column("window").to_pylist()]))
        new = names if not block else [fresh(out, f"{n}_{block}") for n in names]
        fields = ", ".join(f"`{n}` {t}" for n, t in zip(new, ("long", _SPANS, "array<long>"), strict=True))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", " + fields
        out = out.mapInArrow(_searcher(shared, text, out.columns, new), schema)
        if block:
            merged = _merged(F.concat(names[1], new[1]))
            out = out.select(*columns, names[0], merged.alias(names[1]), F.array_union(names[2], new[2]).alias(names[2]))
        if blocks > 1:
            # Each pass is written out before the next, so that one block of phrases is held at a time.
            out, path = stored(out, "decontaminate-pass")
            shared.destroy()
            discard(spark, *passed)
            passed = [path]
    return out, names


def _merged(spans):
    """Overlapping or touching spans made one."""
    return F.aggregate(
        F.array_sort(spans), F.slice(spans, 1, 0),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end_word"] >= s["first_word"]), F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(
                F.element_at(done, -1)["first_word"].alias("first_word"), F.greatest(F.element_at(done, -1)["end_word"], s["end_word"]).alias("end_word"),
                F.element_at(done, -1)["first_byte"].alias("first_byte"), F.greatest(F.element_at(done, -1)["end_byte"], s["end_byte"]).alias("end_byte"))))
        ).otherwise(F.concat(done, F.array(s))))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    Words are runs of digits, letters and non-ASCII characters with A-Z lowered.
    The phrases are all windows of ten words of the ``benchmark`` items (item_id,
    text), or the whole item where it has fewer words.  n_hit counts the words
    inside an occurrence, n_items the items with an occurrence; items_sha256 is
    the digest of their ids, sorted as strings and comma-joined (of the empty
    string where there are none).

    A null or empty text has no words, in either table; an empty benchmark finds
    nothing.  Repeated rows each get their own result, also where doc_id is null
    or repeated.  Only the named columns are read, so extra ones cannot clash.
    """
    phrases = phrase_table(benchmark)
    found, (n_words, spans, keys) = annotate(docs.select("doc_id", "text"), phrases)
    said = F.array_join(F.col(keys).cast("array<string>"), ",").cast("binary")
    found = found.drop("text").withColumn("row_key", F.when(F.size(keys) > 0, F.md5(said))).withColumn("salt", F.pmod(F.hash("doc_id", n_words), F.lit(SALTS)))
    found, _ = stored(found, "decontaminate-found")
    # Rows with the same phrases have the same items: a passage that very many documents share is one key, and its rows are dealt to several tasks.
    held = found.where("row_key is not null").select("row_key", keys).dropDuplicates(["row_key"]).select("row_key", F.explode(keys).alias("phrase"))
    items = held.join(phrases.select("phrase", F.col("item_id").cast("string").alias("item")), "phrase").groupBy("row_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Rows without a phrase have no key and stay out of the join, which would gather them in one task.
    clean = found.where("row_key is null").withColumn("items", F.expr("cast(array() as array<string>)"))
    joined = found.where("row_key is not null").join(items, ["row_key", "salt"]).select(*clean.columns).unionByName(clean)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda t, s: t + s["end_word"] - s["first_word"])
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(spans) > 0).alias("contaminated"), "spans")


def scrubbed(text, spans):
    """The column ``text`` without the byte ranges of ``spans``: the removal that the spans stand for."""
    raw = text.cast("binary")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end_byte"]))
    starts = F.concat(F.transform(spans, lambda s: s["first_byte"]), F.array(F.octet_length(text).cast("long")))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")))
    return F.array_join(F.transform(pieces, lambda p: F.decode(p, "UTF-8")), "")
