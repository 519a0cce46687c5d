"""Vector code compression: product codes trained by heap Lloyd, in exact whole-number arithmetic.

Vectors are cut into equal parts, each position with its own codebook.  In a
block of vectors every entry has a heap of the parts assigned to it, keyed by
slack: lower bound of the distance to the second-nearest entry less upper bound
of the distance to its own, both as of the part's last scan, plus the entry's
drift till then.  An entry's drift adds up, over the rounds, its own moves and
the farthest of the others': while a part's key is above it, the part's bounds
hold and nothing is looked at.  A round pops from each heap the parts whose key
the drift has reached, scans all entries for them exactly, and pushes them onto
the heaps of their nearest.  A heap is stored in ascending order, which is one of
the orders a heap may have, so that a round's pops are its front and are taken
at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagebeam.llm import lloyd
from sagebeam.llm.frames import meet, stored
from sagebeam.llm.lloyd import MARGIN, Codebook, Rounds, cuts, root, squared, table_of, two_nearest

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


class Heaps:
    """The heaps of one position of a block: keys and part numbers, entry after entry, each in ascending order of keys."""

    def __init__(self, keys: np.ndarray, parts: np.ndarray, sizes: np.ndarray):
        self.keys, self.parts, self.sizes = keys, parts, sizes

    @classmethod
    def of(cls, keys: np.ndarray, parts: np.ndarray, entry: np.ndarray, n: int) -> Heaps:
        order = np.lexsort((keys, entry))
        return cls(keys[order], parts[order], np.bincount(entry, minlength=n))

    def entries(self) -> np.ndarray:
        """The entry of each place."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def pop(self, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take off all parts whose key is at most what their entry's drift has reached: the parts and their entries."""
        ends = np.cumsum(self.sizes)
        tops = [int(np.searchsorted(self.keys[b - n : b], r, side="right")) for b, n, r in zip(ends, self.sizes, reached)]
        out = np.zeros(len(self.keys), dtype=bool)
        for b, n, k in zip(ends, self.sizes, tops):
            out[b - n : b - n + k] = True
        popped, entry = self.parts[out], self.entries()[out]
        self.keys, self.parts, self.sizes = self.keys[~out], self.parts[~out], self.sizes - np.array(tops, dtype=self.sizes.dtype)
        return popped, entry

    def push(self, keys: np.ndarray, parts: np.ndarray, entry: np.ndarray) -> None:
        """Put parts onto the heaps of ``entry``."""
        if len(parts):
            again = Heaps.of(np.concatenate([self.keys, keys]), np.concatenate([self.parts, parts]), np.concatenate([self.entries(), entry]), len(self.sizes))
            self.keys, self.parts, self.sizes = again.keys, again.parts, again.sizes

    def packed(self) -> bytes:
        return self.sizes.astype("<i4").tobytes() + self.keys.astype("<f8").tobytes() + self.parts.astype("<i4").tobytes()


def rescan(x: np.ndarray, book: Codebook, heaps: Heaps | None) -> tuple[Heaps, np.ndarray, np.ndarray]:
    """The heaps after a round, and the parts looked at with their entries before (-1: none)."""
    reached = book.wander * (1 + MARGIN)
    if heaps is None:
        popped, was = np.arange(len(x)), np.full(len(x), -1)
        heaps = Heaps(np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(len(book.entries), dtype=np.int64))
    else:
        popped, was = heaps.pop(reached)
    near, value, second = two_nearest(table_of(x[popped], book.matrix(x)))
    upper, lower = root(value) * (1 + MARGIN), root(second) * (1 - MARGIN)
    keys = (lower - upper) + reached[near]
    heaps.push(np.where(np.isfinite(keys), keys - MARGIN * (np.abs(keys) + upper), keys), popped, near)
    return heaps, popped, was


def _packed(all_heaps: list[Heaps]) -> bytes:
    return b"".join(h.packed() for h in all_heaps)


def _unpacked(memory: bytes, n: int, books: list[Codebook]) -> list[Heaps]:
    out, at = [], 0
    for book in books:
        k = len(book.entries)
        sizes = np.frombuffer(memory, "<i4", k, at).astype(np.int64)
        keys = np.frombuffer(memory, "<f8", n, at + 4 * k)
        out.append(Heaps(keys, np.frombuffer(memory, "<i4", n, at + 4 * k + 8 * n).astype(np.int64), sizes))
        at += 4 * k + 12 * n
    return out


def _round(x: np.ndarray, books: list[Codebook], memory: bytes | None) -> tuple[list[Heaps], list[np.ndarray], list[np.ndarray]]:
    """Heaps, entries of all parts, and changes of the sums, by position."""
    held = _unpacked(memory, len(x), books) if memory else [None] * len(books)
    kept, codes, deltas = [], [], []
    for book, heaps, (a, b) in zip(books, held, cuts(x.shape[1], len(books))):
        part = x[:, a:b]
        heaps, popped, was = rescan(part, book, heaps)
        entry = np.empty(len(x), dtype=np.int64)
        entry[heaps.parts] = heaps.entries()
        kept.append(heaps)
        codes.append(entry)
        deltas.append(lloyd.changes(part[popped], was if memory else None, entry[popped], len(book.entries)))
    return kept, codes, deltas


def step(x: np.ndarray, books: list[Codebook], memory: bytes | None) -> tuple[bytes, list[np.ndarray]]:
    kept, _, deltas = _round(x, books, memory)
    return _packed(kept), deltas


def finish(x: np.ndarray, books: list[Codebook], memory: bytes | None) -> list[pa.Array]:
    _, codes, _ = _round(x, books, memory)
    errors = [squared(x[:, a:b], book.matrix(x)[entry]) for book, entry, (a, b) in zip(books, codes, cuts(x.shape[1], len(books)))]
    error = np.sum(np.array(errors, dtype=errors[0].dtype), axis=0) if errors[0].dtype.kind != "O" else sum(errors[1:], errors[0])
    hexed = [bytes(row).hex() for row in np.stack(codes, axis=1).astype(np.uint8)]
    return [pa.array(hexed, pa.string()), lloyd.longs(error)]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per sound vector of ``vectors`` (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    Components become floor(scale * x) and vectors are cut into ``parts``
    consecutive parts.  Each position's codebook starts as that part of the
    ``entries`` (at most 256) smallest vec_ids; ``rounds`` times every part goes to
    the nearest entry (ties: the smaller index) and entries with parts to the
    floor of their mean; then parts are assigned once more.  Rounds end early
    where no entry moves.  error is the sum of the parts' squared distances,
    label_error that of all vectors with an equal label.

    Rows whose vector is null or holds a null or non-finite component are left
    out; with none left the result is empty.  Vectors of different lengths have
    codebooks, and hashes of them, of their own; a length that ``parts`` does
    not divide is cut at its rounded-down multiples, and parts without
    components have error 0.  Repeated rows are vectors like any others; those of
    one vec_id are ordered by components as first entries, null ids come last.
    With fewer vectors than ``entries`` each is one.  Null labels are equal.
    Components beyond +-2^62 stay there; an error, or a sum of errors, that no
    long can hold is null.  Only the three columns are read, so extra ones cannot clash.
    """
    sound = vectors.where(F.expr(lloyd.SOUND)).select("vec_id", "label", "embedding")
    work = Rounds(sound, ["vec_id", "label"], scale, parts, "codes")
    for dims in work.lengths():
        first = sound.where(F.size("embedding") == dims).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
        work.start(dims, np.array([lloyd.whole(np.array(r["embedding"], dtype=np.float64), scale) for r in first]).reshape(len(first), dims))
    for _ in range(rounds if work.books else 0):
        work.pass_over(step)
        if not work.move():
            break
    final, _ = stored(work.last(finish, [("code", T.StringType()), ("error", T.LongType())]).select("dims", F.col("c0").alias("vec_id"), F.struct(F.col("c1").alias("label")).alias("label"), "code", "error"), "codes-final")
    work.close()
    spark = vectors.sparkSession
    # A row per length of vectors.
    digests = [(dims, hashlib.sha256(",".join(str(v) for b in books for e in b.entries for v in e).encode()).hexdigest()) for dims, books in work.books.items()]
    hashed = final.join(F.broadcast(spark.createDataFrame(digests, "dims int, codebooks_sha256 string")), "dims")
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")))
    sums, _ = stored(final.groupBy("label").agg(total.try_cast("long").alias("label_error")), "codes-labels")
    return meet(hashed, sums, "label", sums.count(), "codes-labelled").select("vec_id", "code", "error", "label_error", "codebooks_sha256")
