"""Byte-level tokenising and hashing of Arrow text batches with numpy.

The Python operators of this subpackage never build a Python string per word:
they look at the UTF-8 buffer behind an Arrow column, find word bounds with a
256-entry class table and hash words with a polynomial whose prefix sums wrap
modulo 2^64.  Work goes in slices of about ``SLICE_BYTES``, of which some ten numbers a
byte are in memory at once, so that memory does not follow the batch; a single longer document makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 17
_HASH_BLOCK = 1 << 17

#: ASCII white space: space, tab, LF, VT, FF, CR.
_SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    solid = np.ones(256, dtype=bool)
    solid[list(_SPACE)] = False
    alnum = np.zeros(256, dtype=bool)
    alnum[0x30:0x3A] = True
    alnum[0x41:0x5B] = True  # folded to lower case by the tables below
    alnum[0x61:0x7B] = True
    alnum[0x80:] = True
    return solid, alnum


#: ``SOLID``: runs of anything but white space.  ``ALNUM``: digits, letters and all non-ASCII.
SOLID, ALNUM = _classes()

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit words, the same on every machine."""
    with np.errstate(over="ignore"):
        return splitmix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = stream(11, 256)[FOLD]
_BASE = np.uint64(0x2545F4914F6CDD1D)
_BASE_INV = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            t = np.full(n, base, dtype=np.uint64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of the rows ``lo`` to ``hi`` of a column: row r has the words ``bounds[r-lo]:bounds[r-lo+1]``."""

    lo: int
    hi: int
    data: np.ndarray  # the bytes of the slice
    cuts: np.ndarray  # byte offsets of the rows in ``data``
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """Row number, from 0 in this slice, of every word."""
        return np.repeat(np.arange(self.hi - self.lo), self.counts())

    def hashes(self, head: int = 0, tail: int = 0) -> np.ndarray:
        """A 64-bit hash of every word with A-Z lowered, or of its first ``head`` or last ``tail`` bytes."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        w = 0
        while w < len(out):
            b0 = self.starts[w]
            e = max(w + 1, int(np.searchsorted(self.ends, b0 + _HASH_BLOCK, side="right")))
            data = self.data[b0 : self.ends[e - 1]]
            power, inverse = _power_tables(max(len(data), 1 << 12))
            total = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
            s, t = self.starts[w:e] - b0, self.ends[w:e] - b0
            if head:
                t = np.minimum(t, s + head)
            if tail:
                s = np.maximum(s, t - tail)
            out[w:e] = splitmix((total[t] - total[s]) * inverse[s] + (t - s).astype(np.uint64))
            w = e
        return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null counts as empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return cuts, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)


def slices(cuts: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of at most ``limit`` bytes, or of one longer row."""
    lo, n = 0, len(cuts) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(column: pa.Array, kind: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a string column, slice by slice; ``kind`` is SOLID or ALNUM."""
    cuts, data = buffers(column)
    for lo, hi in slices(cuts, limit):
        own = data[cuts[lo] : cuts[hi]]
        rel = cuts[lo : hi + 1] - cuts[lo]
        inside = kind[own]
        before = np.zeros(len(own), dtype=bool)
        before[1:] = inside[:-1]
        first = rel[:-1][np.diff(rel) > 0]
        before[first] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(own), dtype=bool)
        after[:-1] = inside[1:]
        after[first[1:] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        yield Words(lo, hi, own, rel, starts, ends, np.searchsorted(starts, rel))


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of hashes."""
    return splitmix(h ^ stream(seed, 1)[0])
