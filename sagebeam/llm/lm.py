"""Language-model scores by logistic context mixing.

A token is coded as binary decisions: the path to it in a Huffman tree over the
most frequent words, or an escape and then its bytes by a Huffman tree of bytes.
For every decision three predictors look up how often it went either way in
their context (the node alone, with one and with two words before it; in
spelling, with one byte before it, and with half of the second and of the third).  A mixer adds their log
odds with weights that a gate picks by how much evidence the longer contexts
have, and a final map corrects the mix where it proves off.

Counts are of every context that training has, each its own, and grow with it:
tokens are dealt out by the word before them, so that a task has all
occurrences of its contexts and counts and scores them together.  A word that too
many tokens follow has several tasks, by the word before it; its counts as a
one-word context, a row of symbols, are made first and dealt to these tasks beside
its tokens.  Every task learns weights and the final map for its own contexts, all
of them, from the eighth of the training rows that is a lesson, by counts of the
other rows; then it scores by the counts of all.  The spelling's runs, a byte
with its context, are 24 bits and so at most 2^24; they are scored once and
broadcast.

Beside it stands the base score, a unigram model with add-one smoothing over the
counts of all training tokens; words of the bounded broadcast head are looked up
in place, all others in a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebeam.llm import learning
from sagebeam.llm import textkit as tk
from sagebeam.llm.frames import bounded_batches, stored

#: Words of the broadcast head (16 bytes each) and, of these, words with a code of their own.
HEAD, VOCABULARY = 1 << 19, 1 << 15
ORDERS = 3
#: Tokens of a task, about, and how often learning goes over its decisions.
PART, PASSES = 3 << 18, 2
_RATE, _STEP = 0.02, 1024
_END = np.uint64(0xE0D0_0000_0000_0001)
_START = np.uint64(0x57A7_0000_0000_0001)
_COUNTED = 1 << 21
#: Scores are summed as whole numbers of this part, so that no order of rows changes them.
_UNIT = float(1 << 20)
_BUCKETS, _LEVELS = 33, 4
_KEYS = tk.stream(21, 12) | np.uint64(1)
#: The bits of a hash that a context keeps beside a leaf: 40, enough for the contexts of a task.
_LOW, _HIGH = np.uint64(24), np.uint64(0xFFFF_FFFF_FF00_0000)
#: Bits of each earlier byte that a spelled one's contexts keep, and the mark of the spelling's keys.
_SPELLED = (7, 5, 4)
_GRAM = np.uint64(1 << 40)
_STOP = 0x20  # ends a spelled word; no word has it


def huffman(weights: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by symbol: offsets into, and the nodes and bits of, their paths from the root (node 0)."""
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    new = len(weights)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y] = (new, 0), (new, 1)
        heapq.heappush(heap, (a + b, new))
        new += 1
    offsets, nodes, bits = [0], [], []
    for i in range(len(weights)):
        path = []
        at = i
        while at in up:
            at, bit = up[at]
            path.append((new - 1 - at, bit))
        nodes += [n for n, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
        offsets.append(len(nodes))
    return np.array(offsets), np.array(nodes, dtype=np.uint64), np.array(bits, dtype=np.int64)


@dataclass
class Tree:
    """A code's paths with symbols numbered as the leaves lie, so that a node has consecutive ones."""

    rank: np.ndarray  # by symbol
    depth: np.ndarray  # all others by leaf
    node: np.ndarray
    bit: np.ndarray

    @classmethod
    def make(cls, weights: list[int]) -> Tree:
        offsets, nodes, bits = huffman(weights)
        depth = np.diff(offsets)
        node = np.full((len(depth), max(1, depth.max())), -1, dtype=np.int32)
        bit = np.zeros(node.shape, dtype=np.int8)
        of = np.repeat(np.arange(len(depth)), depth)
        at = np.arange(len(of)) - offsets[of]
        node[of, at], bit[of, at] = nodes, bits
        order = np.lexsort(bit.T[::-1])
        rank = np.empty(len(order), dtype=np.uint16)
        rank[order] = np.arange(len(order))
        return cls(rank, depth[order], np.ascontiguousarray(node[order].T), np.ascontiguousarray(bit[order].T))


@dataclass
class Codes:
    """The head: sorted word hashes with log10(count + 1), symbols (-1: none of its own), and the code trees."""

    hashes: np.ndarray
    logs: np.ndarray
    symbol: np.ndarray
    words: Tree
    letters: Tree
    escape: int
    hot: np.ndarray  # sorted hashes of words that many tokens follow
    spread: np.ndarray  # and over how many tasks each of them goes

    @classmethod
    def make(cls, hashes: np.ndarray, counts: np.ndarray, tokens: int, letters: np.ndarray, parts: int) -> Codes:
        order = np.lexsort((hashes, -counts))[:VOCABULARY]
        symbol = np.full(len(hashes), -1, dtype=np.int64)
        symbol[order] = np.arange(len(order))
        rest = max(1, tokens - int(counts[order].sum()))
        # One more symbol than the escape, so that the tree has a decision even without words.
        words = Tree.make([*counts[order].tolist(), rest, 1])
        # An end is followed by nothing; the mark of a start follows it in its place.
        many = counts * parts > tokens
        hot, spread = np.where(hashes == _END, _START, hashes)[many], np.minimum(counts[many] * parts // max(1, tokens) + 1, parts)
        order = np.argsort(hot)
        return cls(hashes, np.log10(counts + 1.0), symbol, words, Tree.make((letters + 1).tolist()), len(words.depth) - 2, hot[order], spread[order])

    def context(self, hot: np.ndarray) -> np.ndarray:
        """The one-word contexts of hot words, by their places."""
        return tk.splitmix(self.hot[hot]) & _HIGH

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h


@dataclass
class Sequence:
    """The tokens of a slice's rows, each row closed by an end: hash, row, and the word's place (-1 for ends)."""

    words: tk.Words
    hashes: np.ndarray = field(init=False)
    rows: np.ndarray = field(init=False)
    place: np.ndarray = field(init=False)
    bounds: np.ndarray = field(init=False)

    def __post_init__(self):
        w, n = self.words, self.words.hi - self.words.lo
        self.bounds = w.bounds + np.arange(n + 1)
        ends = self.bounds[1:] - 1
        at = np.arange(len(w.starts)) + w.rows()
        self.hashes = np.empty(len(w.starts) + n, dtype=np.uint64)
        self.place = np.full(len(self.hashes), -1, dtype=np.int64)
        self.hashes[ends], self.hashes[at], self.place[at] = _END, w.hashes(), np.arange(len(w.starts))
        self.rows = np.repeat(np.arange(n), np.diff(self.bounds))

    def before(self, k: int) -> np.ndarray:
        """The hash k tokens back, or a start mark."""
        out = np.full(len(self.hashes), _START, dtype=np.uint64)
        out[k:] = self.hashes[:-k]
        for i in range(k):
            out[np.minimum(self.bounds[:-1] + i, len(out) - 1)[self.bounds[:-1] + i < self.bounds[1:]]] = _START
        return out


@dataclass
class Tokens:
    """The tokens of a slice: row, leaf, hashes of one and of two words before, and whether the one is hot (its place, or -1)."""

    rows: np.ndarray
    leaf: np.ndarray
    one: np.ndarray
    two: np.ndarray
    hot: np.ndarray
    spelled: np.ndarray  # tokens that are spelled

    @classmethod
    def make(cls, seq: Sequence, codes: Codes, place: np.ndarray, known: np.ndarray) -> Tokens:
        n = len(seq.hashes)
        one, two = seq.before(1) if n > 1 else np.full(n, _START), seq.before(2) if n > 2 else np.full(n, _START)
        symbol = np.full(n, codes.escape, dtype=np.int64)
        own = known & (codes.symbol[place] >= 0) if len(codes.symbol) else known
        symbol[own] = codes.symbol[place[own]]
        hot = np.full(n, -1, dtype=np.int64)
        if len(codes.hot):
            at = np.minimum(np.searchsorted(codes.hot, one), len(codes.hot) - 1)
            hot = np.where(codes.hot[at] == one, at, -1)
        two = tk.splitmix(one + two * _KEYS[11])
        return cls(seq.rows, codes.words.rank[symbol], tk.splitmix(one) & _HIGH, two & _HIGH, hot, np.flatnonzero((symbol == codes.escape) & (seq.place >= 0)))

    def parts(self, codes: Codes, n: int) -> np.ndarray:
        """Each token's task: its one-word context's own, or, after a hot word, one of that word's by the two-word context."""
        out, hot = _task(self.one, n), np.flatnonzero(self.hot >= 0)
        out[hot] = (out[hot] + _task(self.two[hot], codes.spread[self.hot[hot]])) % n
        return out


def _task(context: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    return ((tk.splitmix(context ^ _KEYS[10]) >> np.uint64(32)) % np.asarray(n).astype(np.uint64)).astype(np.int64)


def _grams(seq: Sequence, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, run) for each byte of the spelled tokens and their stops: 24 bits, the byte, the one of the word before it, and the lower halves of the two before that."""
    # Spelling is worked through in runs of words with a bounded number of bytes.
    size = seq.words.ends[seq.place[tokens]] - seq.words.starts[seq.place[tokens]] + 1
    run = np.cumsum(size) >> 20
    for r in np.unique(run):
        own = tokens[run == r]
        starts, n = seq.words.starts[seq.place[own]], size[run == r]
        of = np.repeat(np.arange(len(own)), n)
        at = np.arange(len(of)) - (np.cumsum(n) - n)[of]
        last = at == n[of] - 1
        letters = np.full(len(of), _STOP, dtype=np.uint32)
        letters[~last] = tk.FOLD[seq.words.data[(starts[of] + at)[~last]]]
        out = letters.copy()
        for k, width in enumerate(_SPELLED, 1):
            earlier = np.zeros(len(letters), dtype=np.uint32)
            earlier[k:] = letters[:-k]
            earlier[at < k] = 0
            out |= (earlier & np.uint32((1 << width) - 1)) << np.uint32(8 + sum(_SPELLED[: k - 1]))
        yield seq.rows[own][of], out


@dataclass
class Entries:
    """Counts by context and leaf, sorted: the contexts' hashes in the upper 40 bits of ``key``, the leaf in the lower."""

    key: np.ndarray
    n: np.ndarray
    lesson: np.ndarray  # of these, counts of lessons
    of: np.ndarray  # each given row's place

    @classmethod
    def make(cls, context: np.ndarray, leaf: np.ndarray, n: np.ndarray, lesson: np.ndarray) -> Entries:
        """``context`` has zeros in its lower 16 bits."""
        key = context | leaf.astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        of = np.empty(len(key), dtype=np.int32)
        of[order] = np.cumsum(new) - 1
        n, lesson = (np.add.reduceat(v[order], starts) if len(starts) else np.zeros(0, np.int64) for v in (n, lesson))
        return cls(key[starts], n, lesson, of)

    def without_lessons(self) -> tuple[Entries, np.ndarray]:
        """The entries of contexts that a lesson has, with the counts of all other rows, and each entry's place among them."""
        context = self.key >> np.uint64(16)
        new = np.ones(len(context), dtype=bool)
        new[1:] = context[1:] != context[:-1]
        starts = np.flatnonzero(new)
        taught = (np.add.reduceat(self.lesson, starts) > 0)[np.cumsum(new) - 1] if len(starts) else new
        return Entries(self.key[taught], (self.n - self.lesson)[taught], self.lesson[taught], self.of[:0]), np.cumsum(taught) - 1

    def levels(self, tree: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each depth of the tree, the log odds and the evidence at the entries' nodes."""
        leaf, context, n = (self.key & np.uint64(0xFFFF)).astype(np.int64), self.key >> np.uint64(16), self.n
        stretch, level = np.zeros(len(leaf), dtype=np.float32), np.zeros(len(leaf), dtype=np.uint8)
        at = np.arange(len(leaf))
        for d in range(len(tree.node)):
            more = tree.depth[leaf] > d
            at, leaf, context, n = at[more], leaf[more], context[more], n[more]
            if len(at):
                node = tree.node[d][leaf]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (node[1:] != node[:-1]) | (context[1:] != context[:-1])
                starts = np.flatnonzero(new)
                ones, both = np.add.reduceat(n * tree.bit[d][leaf], starts), np.add.reduceat(n, starts)
                run = np.cumsum(new) - 1
                stretch[at] = np.clip(np.log(((ones + 0.4) / (both - ones + 0.4)).astype(np.float32)), -9, 9)[run]
                # Evidence of a node: none, little, some, much.
                level[at] = ((both >= 1).astype(np.uint8) + (both >= 4) + (both >= 32))[run]
            yield stretch, level


def _decisions(leaf: np.ndarray, entries: list[Entries], rows: list[np.ndarray], tree: Tree, kind: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """For each depth: which of the leaves have a decision there, their predictors' log odds, gates and bits.  ``rows``: their places in the entries."""
    for d, found in enumerate(zip(*[e.levels(tree) for e in entries], strict=True)):
        at = np.flatnonzero(tree.depth[leaf] > d)
        if not len(at):
            return
        own = [r[at] for r in rows]
        gate = found[1][1][own[1]] * np.uint8(_LEVELS) + found[2][1][own[2]] + np.uint8(kind * _LEVELS * _LEVELS)
        yield at, [f[0][o] for f, o in zip(found, own, strict=True)], gate, tree.bit[d][leaf[at]]


class Mixer:
    """Gated weights and the final map."""

    def __init__(self):
        self.weights = np.full((2 * _LEVELS * _LEVELS, ORDERS), 0.4, dtype=np.float64)
        self.map = np.tile(np.linspace(-8, 8, _BUCKETS), (2, 1))
        self.seen, self.used = np.zeros(len(self.weights)), np.zeros(2)

    @classmethod
    def mean(cls, found: list[Mixer]) -> Mixer:
        """Of mixers that learned apart: each gate's weights and each map by the decisions behind them."""
        out = cls()
        out.seen, out.used = sum((m.seen for m in found), out.seen), sum((m.used for m in found), out.used)
        for g in np.flatnonzero(out.seen):
            out.weights[g] = sum(m.weights[g] * m.seen[g] for m in found) / out.seen[g]
        for k in np.flatnonzero(out.used):
            out.map[k] = sum(m.map[k] * m.used[k] for m in found) / out.used[k]
        return out

    def freeze(self) -> Mixer:
        """The learned weights and map as the single-precision columns that scoring reads."""
        self.columns = [np.ascontiguousarray(self.weights[:, k], dtype=np.float32) for k in range(ORDERS)]
        self.points = [(m.astype(np.float32), np.append(np.diff(m), 0).astype(np.float32)) for m in self.map]
        return self

    def _mapped(self, z: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The map's value for a mix, between the two nearest of its points, and these."""
        t = (np.clip(z, -7.999, 7.999) + 8) * ((_BUCKETS - 1) / 16)
        low = t.astype(np.int64)
        part = t - low
        return self.map[kind][low] * (1 - part) + self.map[kind][low + 1] * part, low, part

    def bits(self, x: list[np.ndarray], gate: np.ndarray, kind: int, bit: np.ndarray) -> np.ndarray:
        """Natural log of the probability given to each decision; the mix and the map's correction count half each."""
        z = x[0] * self.columns[0][gate]
        for k in range(1, ORDERS):
            z += x[k] * self.columns[k][gate]
        t = (np.clip(z, -7.999, 7.999) + np.float32(8)) * np.float32((_BUCKETS - 1) / 16)
        low = t.astype(np.int32)
        t -= low
        points, steps = self.points[kind]
        z = (z + points[low] + t * steps[low]) * np.float32(0.5)
        z = np.where(bit == 1, -z, z)  # log of 1 / (1 + e^z), in single precision: each decision's error is far below its cost
        return -(np.maximum(z, 0) + np.log(1 + np.exp(-np.abs(z))))

    def score(self, leaf: np.ndarray, entries: list[Entries], rows: list[np.ndarray], tree: Tree, kind: int) -> np.ndarray:
        """Natural log of each leaf's probability, in parts of ``_UNIT``."""
        out = np.zeros(len(leaf))
        for at, x, gate, bit in _decisions(leaf, entries, rows, tree, kind):
            out[at] += self.bits(x, gate, kind, bit)
        return np.rint(out * _UNIT).astype(np.int64)

    def learn(self, leaf: np.ndarray, times: np.ndarray, entries: list[Entries], rows: list[np.ndarray], tree: Tree, kind: int) -> None:
        """``PASSES`` over the decisions of leaves that occur ``times``, mixed by a fixed draw, a few at a time."""
        some = np.flatnonzero(times)
        leaf, times, rows = leaf[some], times[some].astype(np.float64), [r[some] for r in rows]
        got = [(np.stack(x, axis=1), gate.astype(np.int64), bit, times[at]) for at, x, gate, bit in _decisions(leaf, entries, rows, tree, kind)]
        if not got:
            return
        x, gate, bit, times = (np.concatenate(v) for v in zip(*got, strict=True))
        order = np.concatenate([np.random.default_rng(5 + i).permutation(len(bit)) for i in range(PASSES)])
        for a in range(0, len(order), _STEP):
            own = order[a : a + _STEP]
            xs, g, y, w = x[own], gate[own], bit[own], times[own]
            z = np.einsum("ij,ij->i", xs, self.weights[g])
            error = (y - learning.sigmoid(z)) * w
            weight = np.bincount(g, weights=w, minlength=len(self.weights))
            self.seen += weight
            self.used[kind] += w.sum()
            # A step by the mean over all occurrences, as long as the number of different decisions makes it.
            n = np.bincount(g, minlength=len(self.weights))
            step = _RATE * n / np.maximum(n, 32) ** 0.5 / np.maximum(weight, 1)
            for k in range(ORDERS):
                self.weights[:, k] += step * np.bincount(g, weights=error * xs[:, k], minlength=len(self.weights))
            value, low, part = self._mapped(z, kind)
            off = (y - learning.sigmoid(value)) * w / w.mean()
            for at, share in ((low, 1 - part), (low + 1, part)):
                self.map[kind] += _RATE * np.bincount(at, weights=off * share, minlength=_BUCKETS)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens (by hash), and of the bytes of words and their stops (``letter``)."""

    def summed(parts: list[np.ndarray], letter: bool) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        return rows(h.view(np.int64), n, letter)

    def rows(word: np.ndarray, n: np.ndarray, letter: bool) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(word), letter)), pa.array(word), pa.array(n.astype(np.int64))], names=["letter", "word", "n"])

    parts, held, letters = [], 0, np.zeros(256, dtype=np.int64)
    for batch in batches:
        for words in tk.words(batch.column("text"), tk.SOLID):
            letters += np.bincount(tk.FOLD[words.data[tk.SOLID[words.data]]], minlength=256)
            letters[_STOP] += len(words.starts)
            h = Sequence(words).hashes
            parts.append(h)
            held += len(h)
            if held >= _COUNTED:
                yield summed(parts, False)
                parts, held = [], 0
    if parts:
        yield summed(parts, False)
    own = np.flatnonzero(letters)
    yield rows(own, letters[own], True)


def _sliced(batch: pa.RecordBatch, codes: Codes) -> Iterator[tuple[Sequence, np.ndarray, np.ndarray, Tokens]]:
    for words in tk.words(batch.column("text"), tk.SOLID, 1 << 22):
        seq = Sequence(words)
        place, known = codes.look(seq.hashes)
        yield seq, place, known, Tokens.make(seq, codes, place, known)


def _count_contexts(shared):
    """Counts of leaves without a context and after hot words (key: place + 1, leaf), and of the spelling's runs (key: 1, run); these of all rows."""

    def summed(parts: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(parts), return_counts=True)
        role = key & np.uint64(3)
        return pa.record_batch([pa.array((key >> np.uint64(2)).view(np.int64)), pa.array(np.where(role > 0, n, 0)), pa.array(np.where(role == 2, n, 0))], names=["key", "n", "lesson"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: Codes = shared.value
        parts, held = [], 0
        for batch in batches:
            roles = batch.column("role").to_numpy().astype(np.uint64)
            for seq, _, _, t in _sliced(batch, codes):
                own = roles[seq.words.lo : seq.words.hi]
                role = own[t.rows]
                leaf, train = t.leaf.astype(np.uint64), role > 0
                after = train & (t.hot >= 0)
                parts += [leaf[train] << np.uint64(2) | role[train], ((t.hot[after] + 1).astype(np.uint64) << np.uint64(16) | leaf[after]) << np.uint64(2) | role[after]]
                parts += [(_GRAM | gram) << np.uint64(2) | own[row] for row, gram in _grams(seq, t.spelled)]
                held += len(role)
                if held >= _COUNTED:
                    yield summed(parts)
                    parts, held = [], 0
        if parts:
            yield summed(parts)

    return run


_DOCUMENT = "slice long, row_key long, doc_id long, held_out boolean, n_tokens long, known long, part double, score long, n_bytes long, rare array<long>, times array<long>"
_DEALT = f"deal int, blob binary, key long, n long, lesson long, {_DOCUMENT}"


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _filled(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.record_batch([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


_DOCUMENT_TYPES = pa.schema([("slice", pa.int64()), ("row_key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("part", pa.float64()), ("score", pa.int64()), ("n_bytes", pa.int64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
_DEALT_TYPES = pa.schema([("deal", pa.int32()), ("blob", pa.binary()), ("key", pa.int64()), ("n", pa.int64()), ("lesson", pa.int64()), *_DOCUMENT_TYPES])


def _pressed(pieces: list[np.ndarray], plain: int = 0) -> bytes:
    """The pieces' bytes: the first ``plain`` as they are, for hashes do not shrink, each other one compressed, with its sizes before it."""
    out = [v.tobytes() for v in pieces[:plain]]
    for v in pieces[plain:]:
        small = pa.compress(v.tobytes(), "zstd", asbytes=True)
        out += [np.array([v.nbytes, len(small)], np.uint32).tobytes(), small]
    return b"".join(out)


def _raised(blob: bytes, at: int, kind: type) -> tuple[np.ndarray, int]:
    """The compressed piece that begins at ``at``, and where the next one does."""
    size, small = np.frombuffer(blob, np.uint32, 2, at).tolist()
    at += 8
    return np.frombuffer(pa.decompress(blob[at : at + small], size, "zstd", asbytes=True), kind), at + small


def _packed(t: Tokens, roles: np.ndarray, codes: Codes, parts: int, first: int) -> Iterator[tuple[int, bytes]]:
    """The tokens of a slice by task: different (one, two, leaf) with the rows, and their roles, that have them."""
    deal, one, two, leaf, rows = t.parts(codes, parts), t.one, t.two, t.leaf, t.rows
    # By task, then by hashes of the word before and of the rest: like tokens are together, and hardly ever others between them.
    key = deal.astype(np.uint64) << np.uint64(43) | one >> np.uint64(43) << np.uint64(22) | (two + leaf * _KEYS[9]) * _KEYS[8] >> np.uint64(42)
    order = np.argsort(key)
    deal, one, two, leaf, rows = deal[order], one[order], two[order], leaf[order], rows[order]
    own = rows.astype(np.uint16) | (roles[rows] << 14).astype(np.uint16)
    cuts = np.searchsorted(deal, np.arange(parts + 1))
    fresh = np.ones(len(deal), dtype=bool)
    fresh[1:] = one[1:] != one[:-1]
    new = fresh.copy()
    new[1:] |= (two[1:] != two[:-1]) | (leaf[1:] != leaf[:-1])
    for p in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[p], cuts[p + 1]
        new[a] = fresh[a] = True
        at, begin = np.flatnonzero(new[a:b]) + a, np.flatnonzero(fresh[a:b]) + a
        times, runs = np.diff(np.append(at, b)), np.diff(np.append(np.searchsorted(at, begin), len(at)))
        # Of the second word 32 bits: they only tell a task's contexts after one word apart, which are at most about PART.
        x, y = one[begin] >> _LOW, two[at] >> _LOW
        yield int(p), _pressed([np.array([first, len(at), len(begin)]), x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint8), y.astype(np.uint32), runs.astype(np.uint32), leaf[at], times.astype(np.uint32), own[a:b]], 4)


def _unpacked(blob: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The slice's first row key; one, two, leaf and times of its different tokens; and rows with roles."""
    first, n, m = np.frombuffer(blob, np.int64, 3).tolist()
    out, at = [], 24
    for kind, size in ((np.uint32, m), (np.uint8, m), (np.uint32, n)):
        out.append(np.frombuffer(blob, kind, size, at))
        at += out[-1].nbytes
    for kind in (np.uint32, np.uint16, np.uint32, np.uint16):
        piece, at = _raised(blob, at, kind)
        out.append(piece)
    one = np.repeat((out[0].astype(np.uint64) | out[1].astype(np.uint64) << np.uint64(32)) << _LOW, out[3])
    return first, one, tk.splitmix(one + out[2] * _KEYS[11]) & _HIGH, out[4], out[5], out[6]


def _hot_dealer(shared, parts: int):
    """The counts after hot words, each for all tasks of its word; ``key``: the context and the leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: Codes = shared.value[0]
        for batch in batches:
            key, n, lesson = (batch.column(c).to_numpy() for c in ("key", "n", "lesson"))
            place = (key >> 16) - 1
            context = codes.context(place)
            for a in range(0, len(place), 64):  # a word has at most as many tasks as there are
                k = codes.spread[place[a : a + 64]]
                of = np.repeat(np.arange(a, a + len(k)), k)
                deal = (_task(context[of], parts) + np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)) % parts
                yield _filled({"deal": pa.array(deal), "key": pa.array((context[of] | (key[of] & 0xFFFF).astype(np.uint64)).view(np.int64)), "n": pa.array(n[of]), "lesson": pa.array(lesson[of])}, _DEALT_TYPES)

    return run


def _dealer(shared, parts: int):
    """Documents with what needs no context, and the tokens by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, spelling, _ = shared.value
        task = TaskContext.get().partitionId()
        row_key = task << 33
        for batch in batches:
            n = batch.num_rows
            roles = batch.column("role").to_numpy()
            tokens, known, part, score, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            slices = np.zeros(n, np.int64)
            rare: list[np.ndarray] = [np.zeros(0, np.int64)] * n
            times: list[np.ndarray] = [np.zeros(0, np.int64)] * n
            for seq, place, have, t in _sliced(batch, codes):
                words = seq.words
                lo, rows = words.lo, words.hi - words.lo
                got = list(_packed(t, roles[lo : words.hi], codes, parts, row_key + lo))
                for a in range(0, len(got), 64):
                    yield _filled({"deal": pa.array([p for p, _ in got[a : a + 64]]), "blob": pa.array([b for _, b in got[a : a + 64]], pa.binary())}, _DEALT_TYPES)
                slices[lo : words.hi] = row_key + lo
                tokens[lo : words.hi] = np.diff(seq.bounds)
                size[lo : words.hi] = np.diff(words.cuts)
                known[lo : words.hi] = np.bincount(seq.rows[have], minlength=rows)
                part[lo : words.hi] = np.bincount(seq.rows[have], weights=codes.logs[place[have]], minlength=rows) if len(codes.logs) else 0
                for row, gram in _grams(seq, t.spelled):
                    # Sums of whole numbers below 2^53 are exact.
                    score[lo : words.hi] += np.bincount(row, weights=spelling[1][np.searchsorted(spelling[0], gram)], minlength=rows).astype(np.int64)
                h, r = seq.hashes[~have], seq.rows[~have]
                order = np.lexsort((h, r))
                h, r = h[order], r[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(h)))
                cuts = np.searchsorted(r[at], np.arange(rows + 1))
                for i in range(rows):
                    rare[lo + i], times[lo + i] = h[at[cuts[i] : cuts[i + 1]]].view(np.int64), count[cuts[i] : cuts[i + 1]]
            keys = row_key + np.arange(n)
            row_key += n
            if n:
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int32)), pa.array(np.concatenate(x).astype(np.int64))) for x in (rare, times)]
                made = [pa.array(slices), pa.array(keys), batch.column("doc_id"), batch.column("held_out"), pa.array(tokens), pa.array(known), pa.array(part), pa.array(score), pa.array(size), *lists]
                yield _filled({"deal": pa.array(np.full(n, task % parts)), **dict(zip(_names(_DOCUMENT), made, strict=True))}, _DEALT_TYPES)

    return run


class Block:
    """All tokens of a task: their entries after one and two words, the hot words' own rows (key, n, lesson) among them."""

    def __init__(self, blobs: list[bytes], hot: np.ndarray):
        got = [_unpacked(b) for b in blobs]
        one, two, leaf, self.times, own = (np.concatenate([g[k] for g in got]) for k in range(1, 6))
        self.slices, self.cuts, self.own = [g[0] for g in got], np.cumsum([0, *(len(g[5]) for g in got)]), own & np.uint16(0x3FFF)
        got.clear()
        starts = np.cumsum(self.times, dtype=np.int64) - self.times
        n, lesson = (np.add.reduceat((own >> 14 >= role).astype(np.int64), starts) for role in (1, 2))
        key = hot[0].view(np.uint64)
        context = key & ~np.uint64(0xFFFF)
        told = np.isin(one, np.unique(context))  # their counts come with the rows
        before = Entries.make(np.concatenate([one, context]), np.concatenate([leaf, (key & np.uint64(0xFFFF)).astype(leaf.dtype)]), *(np.concatenate([np.where(told, 0, v), h]) for v, h in ((n, hot[1]), (lesson, hot[2]))))
        after = Entries.make(two, leaf, n, lesson)
        # A token is as its entry after two words, however many slices have it.
        self.entries, self.row = [before, after], after.of
        self.before = np.empty(len(after.key), dtype=np.int32)
        self.before[after.of] = before.of[: len(leaf)]
        self.leaf = (after.key & np.uint64(0xFFFF)).astype(np.int64)

    def taught(self, base: Entries, tree: Tree) -> Mixer:
        """The weights that this task's lessons teach, by the counts of the rows that are none."""
        mixer, after = Mixer(), self.entries[1]
        less, place = zip(*(e.without_lessons() for e in self.entries), strict=True)
        own = np.flatnonzero(after.lesson)
        mixer.learn(self.leaf[own], after.lesson[own], [Entries(base.key, base.n - base.lesson, base.lesson, base.of), *less], [self.leaf[own], place[0][self.before[own]], place[1][own]], tree, 0)
        return mixer

    def costs(self, base: Entries, tree: Tree, mixer: Mixer) -> np.ndarray:
        """Of every occurrence of a token, in the order of the slices."""
        return np.repeat(-mixer.score(self.leaf, [base, *self.entries], [self.leaf, self.before, np.arange(len(self.leaf))], tree, 0)[self.row], self.times)


def _blocks(batches: Iterator[pa.RecordBatch], rest: list[pa.RecordBatch]) -> dict[int, tuple[list[bytes], np.ndarray]]:
    """Blobs and hot words' rows by task, in an order that no run changes; rows of documents go to ``rest``."""
    blobs: dict[int, list[bytes]] = {}
    hot: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for deal, blob in zip(batch.column("deal").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if blob is not None:
                blobs.setdefault(deal, []).append(blob)
        own = batch.filter(batch.column("key").is_valid())
        deals = own.column("deal").to_numpy()
        for p in np.unique(deals).tolist():
            hot.setdefault(p, []).append(np.stack([own.column(c).to_numpy() for c in ("key", "n", "lesson")])[:, deals == p])
        own = batch.filter(batch.column("row_key").is_valid())
        if own.num_rows:
            rest.append(own.select(_DOCUMENT_TYPES.names))
    none = [np.zeros((3, 0), np.int64)]
    return {p: (sorted(b), np.concatenate(hot.get(p, none), axis=1)) for p, b in sorted(blobs.items())}


def _scorer(shared, settle):
    """Learns from and scores each task's tokens; ``settle`` makes the weights to score with of the mixers that learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, base = shared.value[0], shared.value[2]
        rest: list[pa.RecordBatch] = []
        found = _blocks(batches, rest)
        for batch in rest:
            yield _filled({f: batch.column(f) for f in batch.schema.names}, _DEALT_TYPES)
        rest.clear()
        for p in list(found):
            block = Block(*found.pop(p))
            mixer = settle([block.taught(base, codes.words)]).freeze()
            cost = block.costs(base, codes.words, mixer)
            packed = []
            for a, b in zip(block.cuts[:-1], block.cuts[1:], strict=True):
                total = np.bincount(block.own[a:b], weights=cost[a:b]).astype(np.uint64)
                packed.append(_pressed([total.astype(np.uint32), (total >> np.uint64(32)).astype(np.uint32)]))
            for a in range(0, len(packed), 1024):
                yield _filled({"blob": pa.array(packed[a : a + 1024], pa.binary()), "slice": pa.array(block.slices[a : a + 1024])}, _DEALT_TYPES)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents with what tasks found of their slices added to their scores."""
    rest: list[pa.RecordBatch] = []
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, blob in zip(batch.column("slice").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if blob is not None:
                low, at = _raised(blob, 0, np.uint32)
                low, high = low.astype(np.int64), _raised(blob, at, np.uint32)[0].astype(np.int64)
                sums.setdefault(key, np.zeros(1 << 14, np.int64))[: len(low)] += low + (high << 32)
        own = batch.filter(batch.column("row_key").is_valid())
        if own.num_rows:
            rest.append(own.select(_DOCUMENT_TYPES.names))
    for batch in rest:
        keys, slices = batch.column("row_key").to_numpy(), batch.column("slice").to_numpy()
        score = batch.column("score").to_numpy() - np.array([sums[s][k - s] for s, k in zip(slices.tolist(), keys.tolist(), strict=True)])
        yield pa.record_batch([pa.array(score) if f == "score" else batch.column(f) for f in _DOCUMENT_TYPES.names], names=_DOCUMENT_TYPES.names)


def _head(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, at most ``most``: sorted hashes and counts.  Whole classes of like counts, by eighths of a power of two."""
    size = F.floor(F.log2("n") * 8).cast("int")
    left, least = most, None
    for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).orderBy(F.desc("size")).collect():
        if r["words"] > left:
            break
        left, least = left - r["words"], r["size"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = counts.where(size >= least).select("word", "n").toArrow()
    h, n = got.column("word").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def scores(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Tokens are words between ASCII white space, A-Z lowered, and one end a text.
    Learned from are rows whose crc32(doc_id as text) mod 7 is not 2 (held_out: it
    is 2).  n_known counts tokens that training has, train_tokens all training
    tokens; base_score is the add-one unigram log10 probability and score the
    mixing model's; bits_per_byte is the latter over the text's bytes, null for
    an empty text.

    Null, empty and blank texts are one end.  A null doc_id is scored, neither
    held out nor learned from.  Repeated rows count in training as often as they
    are there and get equal scores.  With nothing to learn from, base_score is 0
    and the model gives every decision what its prior weights give.  Only the two
    columns are read.
    """
    spark = bounded_batches(docs.sparkSession)
    fold = learning.fold(F.col("doc_id"), 7)
    slim = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"))
    lesson = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(8)) == 0
    slim = slim.withColumn("role", F.when(F.col("doc_id").isNull() | F.col("held_out"), 0).when(lesson, 2).otherwise(1))
    train = slim.where("role > 0")
    counted, _ = stored(train.select("text").mapInArrow(_count_words, "letter boolean, word long, n long").groupBy("letter", "word").agg(F.sum("n").alias("n")), "lm-words")
    counts, letters = counted.where("not letter").select("word", "n"), np.zeros(256, dtype=np.int64)
    for r in counted.where("letter").collect():  # 256 rows at most
        letters[r["word"]] = r["n"]
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    hashes, n = _head(counts, head)
    parts = max(1, round(total["tokens"] / PART))
    codes = Codes.make(hashes, n, total["tokens"], letters, parts)
    shared = spark.sparkContext.broadcast(codes)  # at most 24 bytes a word of the head
    seen, _ = stored(slim.select("text", "role").mapInArrow(_count_contexts(shared), "key long, n long, lesson long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("lesson").alias("lesson")), "lm-contexts")
    after_hot = (F.col("key") >= 1 << 16) & (F.col("key") < int(_GRAM))
    alone = seen.where(~after_hot).toArrow()  # a count for each leaf, and for each run of the spelling: at most 2^24
    key, n, own = (alone.column(c).to_numpy() for c in ("key", "n", "lesson"))
    order = np.argsort(key)
    key, n, own = key[order], n[order], own[order]
    a = int(np.searchsorted(key, int(_GRAM)))
    leaves, none = np.arange(len(codes.words.depth)), np.zeros(len(codes.words.depth), np.int64)
    base = Entries.make(np.zeros(len(leaves) + a, np.uint64), np.concatenate([leaves, key[:a]]), np.concatenate([none, n[:a]]), np.concatenate([none, own[:a]]))
    gram = (key[a:] & 0xFF_FFFF).astype(np.uint32)
    letter = codes.letters.rank[gram & 0xFF].astype(np.int64)

    def spelled(n: np.ndarray) -> list[Entries]:
        return [Entries.make((gram >> np.uint32(8)).astype(np.uint64) % np.uint64(1 << sum(_SPELLED[: k + 1])) << np.uint64(16), letter, n, own[a:]) for k in range(ORDERS)]

    speller = Mixer()
    entries = spelled(n[a:] - own[a:])
    speller.learn(letter, own[a:], entries, [e.of for e in entries], codes.letters, 1)
    entries = spelled(n[a:])
    spelling = (gram, Mixer.mean([speller]).freeze().score(letter, entries, [e.of for e in entries], codes.letters, 1))
    model = spark.sparkContext.broadcast((codes, spelling, base))
    hot = seen.where(after_hot).mapInArrow(_hot_dealer(model, parts), _DEALT)
    dealt = slim.mapInArrow(_dealer(model, parts), _DEALT).unionByName(hot).repartitionById(parts, F.col("deal"))
    scored, _ = stored(dealt.mapInArrow(_scorer(model, Mixer.mean), _DEALT).repartition(parts, "slice").mapInArrow(_added, _DOCUMENT), "lm-scored")
    # Words beyond the head: each is rare, so its key is never hot.
    rest = scored.select("row_key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row_key", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = rest.join(counts, "word").groupBy("row_key").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("also"))
    below = float(np.log10(total["tokens"] + total["words"] + 1.0))
    nothing = F.lit(0)
    return scored.withColumn("score", F.col("score") / F.lit(_UNIT * float(np.log(10)))).join(met, "row_key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", nothing)).alias("n_known"), F.lit(int(total["tokens"])).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * below).alias("base_score"), "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"))

