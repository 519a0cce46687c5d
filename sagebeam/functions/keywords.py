"""Which of many keyword groups a text holds, in one reading: an automaton over the bytes of all keywords.

States are the prefixes of keywords; a table tells the next state for every byte,
and each state which groups' keywords end there.  Texts are cut into pieces that
overlap by the longest keyword, and all pieces of a batch take a step at a time, so
that a step is a look-up of arrays and the number of keywords costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a piece, and pieces that step together.
PIECE, TOGETHER = 256, 1 << 16


class Automaton:
    """The states of all keywords of ``groups``; an empty keyword is in every text."""

    def __init__(self, groups: Sequence[Sequence[str]]):
        words = [(t.encode(), g) for g, terms in enumerate(groups) for t in terms]
        self.always = sorted({g for w, g in words if not w})
        self.longest = max((len(w) for w, _ in words), default=1)
        prefixes = sorted({w[:i] for w, _ in words for i in range(len(w) + 1)} | {b""}, key=lambda p: (len(p), p))
        number = {p: i for i, p in enumerate(prefixes)}
        ends: dict[bytes, set[int]] = {p: set() for p in prefixes}
        for w, g in words:
            ends[w].add(g)
        longer: dict[bytes, list[tuple[int, int]]] = {p: [] for p in prefixes}
        for p in prefixes[1:]:
            longer[p[:-1]].append((p[-1], number[p]))
        self.step = np.zeros((len(prefixes), 256), dtype=np.int32)
        shorter = {b"": b""}
        for p in prefixes:  # by length, so that a shorter suffix's row is made before
            if p:
                # The longest proper suffix that is a prefix of a keyword is one step beyond that of the state before.
                shorter[p] = prefixes[self.step[number[shorter[p[:-1]]], p[-1]]] if len(p) > 1 else b""
                ends[p] |= ends[shorter[p]] if shorter[p] else set()
                self.step[number[p]] = self.step[number[shorter[p]]]
            for byte, to in longer[p]:
                self.step[number[p], byte] = to
        self.found = np.array([bool(ends[p]) and p != b"" for p in prefixes])
        groups_of = [sorted(ends[p]) if p else [] for p in prefixes]
        self.many = np.array([len(g) for g in groups_of], dtype=np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.groups = np.array([g for of in groups_of for g in of], dtype=np.int64)
        self.n = len(groups)

    def pairs(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, group), each once and ascending, for texts at ``starts`` of the bytes ``data``."""
        if not len(starts):
            return starts, starts
        stride = PIECE
        pieces = np.maximum(1, -(-np.maximum(sizes - self.longest + 1, 1) // stride))
        of = np.repeat(np.arange(len(starts)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(pieces)[:-1]]), pieces)
        begin = starts[of] + nth * stride
        length = np.minimum(starts[of] + sizes[of] - begin, stride + self.longest - 1)
        out = [np.repeat(np.arange(len(starts)), len(self.always)) * self.n + np.tile(np.array(self.always, dtype=np.int64), len(starts))]
        for a in range(0, len(of), TOGETHER):
            order = a + np.argsort(-length[a : a + TOGETHER], kind="stable")
            left, state = length[order], np.zeros(len(order), dtype=np.int32)
            for i in range(int(left[0]) if len(left) else 0):
                live = int(np.searchsorted(-left, -i, side="left"))  # pieces are in descending order of length
                state = self.step[state[:live], data[begin[order[:live]] + i]]
                hit = np.flatnonzero(self.found[state])
                if len(hit):
                    ended, text = state[hit], of[order[hit]]
                    many = self.many[ended]
                    at = np.arange(many.sum()) + np.repeat(self.first[ended] - (np.cumsum(many) - many), many)
                    out.append(np.repeat(text, many) * self.n + self.groups[at])
        both = np.unique(np.concatenate(out))
        return np.divmod(both, max(1, self.n))

    def __call__(self, texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        starts = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
        text, group = self.pairs(np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8), starts[:-1], np.diff(starts))
        ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(group, pa.int32()))


def groups_in(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Numbers of the groups a keyword of which ``text`` holds, inside words too, ascending; a null text is an empty one.

    Select it once and go on from the column, as it is no expression that Spark
    may move or repeat.
    """
    return _column(Automaton(groups))(F.coalesce(text, F.lit("")))


def _column(machine: Automaton):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield machine(batch)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>").asNondeterministic()


#: Bytes of the keywords of one automaton at most; its table has a kilobyte for each.
TABLE = 60_000


def tables(terms: Sequence[str]) -> list[list[str]]:
    """``terms`` in runs that fit an automaton each."""
    out, size = [[]], 0
    for t in terms:
        if size and size + len(t.encode()) > TABLE:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t.encode())
    return out


def with_terms(rows: DataFrame, text: str, terms: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``name``, the numbers of the ``terms`` that the column ``text`` holds; the text is read once per ``TABLE`` bytes of terms."""
    parts, at = [], 0
    for i, run in enumerate(tables(terms)):
        column, base = f"_{name}{i}", at
        rows = rows.withColumn(column, groups_in(F.col(text), [(t,) for t in run]))
        parts.append((column, base))
        at += len(run)
    shifted = lambda column, base: F.transform(F.col(column), lambda g: g + F.lit(base))
    found = F.concat(*[shifted(*p) for p in parts])
    return rows.withColumn(name, found).drop(*[c for c, _ in parts])
