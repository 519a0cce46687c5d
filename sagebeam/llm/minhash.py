"""MinHash near-dedup with min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum
and its maximum, so ``PERMUTATIONS`` hash evaluations make a signature twice as
long.  Bands of several values key the buckets.  Nodes are distinct shingle
sets, so copies never meet as pairs.  Buckets first link every member to the
bucket's smallest node; links are confirmed on the full sets and joined to
components, and only pairs of a bucket that these leave apart are looked at
again, in tiles of bounded size that send back a forest of confirmed links.
Pairs inside a component need no check: they could not change it.  A bucket of
several tiles is parted first, by what its members have besides its most central
one, so that a group of near copies does not meet itself in tiles.  Bands are as
long as the threshold allows for a pair at it to share no bucket with a
probability of at most ``MISSED`` (6 rows at 0.85, 5 at 0.80: both 2e-6).
Buckets that many nodes share are joined by broadcast, so that none is one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagebeam.llm import textkit as tk
from sagebeam.llm.frames import bounded_batches, components, discard, narrow, stored

PERMUTATIONS = 84
#: Probability with which a pair at the threshold may share no bucket.
MISSED = 1e-5
SHINGLE = 5
#: Members of a bucket, and shingles of theirs, that one tile compares at most with as many others, on average.
TILE, TILE_SHINGLES = 512, 1 << 20
#: Buckets with more than this share of all places in buckets are hot; there are fewer than its inverse.
HOT = 1e-4
SALTS = 64
#: Standard deviations of the signature's estimate below the threshold at which a pair of a tile is dropped.
SIGMAS = 6.0

_MULTIPLIERS = tk.stream(9, PERMUTATIONS) | np.uint64(1)
_ORDER = np.argsort(tk.stream(10, 2 * PERMUTATIONS))
_ROW_KEYS = tk.stream(12, 2 * PERMUTATIONS)
_SHINGLE_KEYS = tk.stream(5, SHINGLE)


def rows_of_bands(percent: int) -> int:
    """The longest bands that miss a pair at ``percent`` with a probability of at most ``MISSED``."""
    p, n = percent / 100, 2 * PERMUTATIONS
    return max([r for r in range(1, n + 1) if (1 - p**r) ** (n // r) <= MISSED], default=1)


def shingle_sets(words: tk.Words) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every row; fewer than five words make one shingle, none make an empty set."""
    h = words.hashes()
    g = tk.splitmix(sum(h[i : len(h) - SHINGLE + 1 + i] * _SHINGLE_KEYS[i] for i in range(SHINGLE))) if len(h) >= SHINGLE else h[:0]
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(g[a : b - SHINGLE + 1])
        elif b > a:
            yield tk.mixed((h[a:b] * _SHINGLE_KEYS[: b - a]).sum(keepdims=True), int(b - a))
        else:
            yield g[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima and then the maxima of the permuted hashes."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for i in range(0, len(shingles), 4096):
        permuted = shingles[None, i : i + 4096] * _MULTIPLIERS[:, None]
        np.minimum(low, permuted.min(axis=1), out=low)
        np.maximum(high, permuted.max(axis=1), out=high)
    return np.concatenate([low, high])[_ORDER]


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _binaries(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, type=pa.binary())


def _signer(long: int):
    n_bands = 2 * PERMUTATIONS // long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, bands, sketches = [], [], [], []
            for words in tk.words(batch.column("text"), tk.SOLID):
                for s in shingle_sets(words):
                    sizes.append(len(s))
                    if not len(s):
                        nodes.append(None), bands.append(None), sketches.append(None)
                        continue
                    sig = signature(s)
                    keys = tk.mixed((sig[: n_bands * long].reshape(n_bands, long) * _ROW_KEYS[:long]).sum(axis=1), 77) + np.arange(n_bands, dtype=np.uint64)
                    nodes.append(_node(s))
                    bands.append(tk.splitmix(keys).view(np.int64))
                    sketches.append(tk.splitmix(sig).astype(np.uint8).tobytes())
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), _binaries(sketches)],
                names=["doc_id", "text_key", "n_shingles", "node", "bands", "sketch"],
            )

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for words in tk.words(batch.column("text"), tk.SOLID) for s in shingle_sets(words)]
        yield pa.record_batch([batch.column("node"), _binaries(sets)], names=["node", "shingles"])


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("of_a"), batch.column("of_b"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return confirm


def _differ(percent: int):
    """Over pairs of a centre a and a member b: the size of b's set, how much of it is in a's, whether they link, whether b is the smaller, and b's shingles that a has not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, both, linked, smaller, own = [], [], [], [], []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                rest = y[x[np.minimum(np.searchsorted(x, y), len(x) - 1)] != y]
                sizes.append(len(y)), both.append(len(y) - len(rest)), smaller.append(len(y) < len(x)), own.append(rest.view(np.int64))
                linked.append(100 * both[-1] >= percent * (len(x) + len(rest)))
            yield pa.record_batch(
                [*(batch.column(c) for c in ("a", "b", "root_a", "root_b")), pa.array(sizes, pa.int64()), pa.array(both, pa.int64()), pa.array(linked, pa.bool_()), pa.array(smaller, pa.bool_()), pa.array(own, pa.list_(pa.int64()))],
                names=["a", "b", "root_a", "root_b", "n_shingles", "both", "linked", "smaller", "own"],
            )

    return run


class _Roots:
    """Union-find over the components that meet in a tile."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def union(self, x: int, y: int) -> None:
        self.up[self.find(x)] = self.find(y)


def _tile_links(x: dict[str, np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Links of one tile that join components, told by the components' labels: a spanning forest of them, confirmed on the full sets.

    Looked at are pairs of different components, of near sizes, whose signatures
    agree nearly enough, in the first band that they share; a bucket of no band looks at all of its pairs.
    """
    if x["ti"][0] == x["tj"][0]:
        left = right = np.arange(len(x["part"]))
    else:
        left, right = np.flatnonzero(x["part"] == 0), np.flatnonzero(x["part"] == 1)
    floor = percent / 100 - SIGMAS * (percent / 100 * (1 - percent / 100) / (2 * PERMUTATIONS)) ** 0.5
    size, root, roots = x["n_shingles"], x["root"], _Roots()
    sets = [np.frombuffer(v, dtype=np.uint64) for v in x["shingles"]]
    shingles = np.unique(np.concatenate(sets))
    numbers = [np.searchsorted(shingles, s) for s in sets]
    present = np.zeros(len(shingles), dtype=bool)
    out_a, out_b = [], []
    for i in left:
        j = right if left is not right else right[right > i]
        j = j[(root[j] != root[i]) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))]
        if len(j):
            j = j[(x["sketch"][j] == x["sketch"][i]).mean(axis=1) >= floor]
        if len(j) and x["band"][i] >= 0:
            j = j[(x["bands"][j] == x["bands"][i]).argmax(axis=1) == x["band"][i]]
        if not len(j):
            continue
        present[numbers[i]] = True
        for k in j:
            if roots.find(root[i]) == roots.find(root[k]):
                continue
            both = int(np.count_nonzero(present[numbers[k]]))
            if 100 * both >= percent * (size[i] + size[k] - both):
                roots.union(root[i], root[k])
                out_a.append(x["root"][i]), out_b.append(x["root"][k])
        present[numbers[i]] = False
    return out_a, out_b


def _tiler(percent: int):
    """Over rows sorted by tile: the links that each tile finds."""
    names = ("node", "root", "n_shingles", "part", "band", "bucket", "ti", "tj")

    def unpack(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        x = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        x["bands"] = batch.column("bands").flatten().to_numpy().reshape(batch.num_rows, -1)
        x["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, 2 * PERMUTATIONS)
        x["shingles"] = np.array(batch.column("shingles").to_pylist(), dtype=object)
        return x

    def links(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        a, b = _tile_links(x, percent)
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            x = unpack(batch)
            if held is not None:
                x = {k: np.concatenate([held[k], x[k]]) for k in x}
            key = np.stack([x["bucket"], x["ti"], x["tj"]], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
            for lo, hi in zip(cuts[:-2], cuts[1:-1], strict=True):
                yield links({k: v[lo:hi] for k, v in x.items()})
            held = {k: v[cuts[-2] :] for k, v in x.items()}
        if held is not None:
            yield links(held)

    return run


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept; also text_key and node.

    Two documents link when 100 * |intersection| >= percent * |union| of their
    sets of five-word shingles (words between ASCII white space, A-Z lowered).
    component_id is the smallest doc_id reachable by links, itself included;
    kept is doc_id = component_id.

    Null, empty or blank text: n_shingles 0, linked with nothing, so it is its own
    component.  Texts of one to four words have one shingle, the whole sequence.
    Repeated rows and texts that differ only in case or spacing fall in one
    component.  A null doc_id joins its component but never names one; where no
    member has an id, component_id is null and kept is null.  Only doc_id and
    text are read, so extra columns cannot clash.
    """
    return _marked(docs, percent)[0]


def _marked(docs: DataFrame, percent: int) -> tuple[DataFrame, list[str]]:
    """The rows of ``near_duplicates``, and the paths that they read."""
    spark = bounded_batches(docs.sparkSession)
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    signed, signed_path = stored(slim.mapInArrow(_signer(rows_of_bands(percent)), "doc_id long, text_key long, n_shingles long, node long, bands array<long>, sketch binary"), "minhash-signed")

    # A node per distinct set; of its copies one stands for all, whatever their number.
    nodes, nodes_path = stored(
        signed.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("least_id"), F.min(F.struct("text_key", "doc_id")).alias("text_of"),
            F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "minhash-nodes")
    in_band = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    hubs, hubs_path = stored(narrow(in_band.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.count("*").alias("members")).where("hub <> top").drop("top")), "minhash-hubs")
    placed, placed_path = stored(narrow(_by_bucket(in_band, hubs)), "minhash-placed")
    spokes = placed.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links, links_path = _linked(docs, nodes, spokes, percent)
    roots, root_paths = components(links, "minhash-first")

    # Written once, as the steps below read it several times.
    named, named_path = stored(narrow(nodes.join(roots, "node", "left").select("node", "least_id", "n_shingles", F.coalesce("root", "node").alias("root"))), "minhash-rooted")
    discard(spark, hubs_path, links_path, *root_paths)
    paths = [nodes_path, placed_path, named_path]

    apart, apart_path = stored(narrow(placed.where("node <> hub and members > 2").drop("members", "hub").join(named.select("node", "root", "n_shingles"), "node")), "minhash-apart")
    open_buckets, open_path = stored(narrow(_open(apart)), "minhash-open")
    if open_buckets.limit(1).count():
        more, more_path = _joining(docs, nodes, apart, open_buckets, percent)
        # Labels are the smallest nodes of their components, so the smallest of joined labels is the smallest node.
        over, over_paths = components(more, "minhash-final")
        over = over.select(F.col("node").alias("root"), F.col("root").alias("over"))
        named, joined_path = stored(narrow(named.join(over, "root", "left").select("node", "least_id", F.coalesce("over", "root").alias("root"))), "minhash-named")
        paths += [more_path, joined_path, *over_paths]

    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known, known_path = stored(narrow(named.join(least, "root").select("node", "component_id")), "minhash-known")
    discard(spark, apart_path, open_path, *paths)
    out = signed.select("doc_id", "text_key", "n_shingles", "node").join(known, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "text_key", "node"), [signed_path, known_path]


def _open(places: DataFrame) -> DataFrame:
    """Buckets (bucket, members, tiles) of ``places`` (bucket, root, n_shingles) that hold more than one component."""
    buckets = places.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("members"), F.sum("n_shingles").alias("shingles")).where("x <> y")
    return buckets.select("bucket", "members", F.ceil(F.greatest(F.col("members") / TILE, F.col("shingles") / TILE_SHINGLES)).cast("int").alias("tiles"))


def _joining(docs: DataFrame, nodes: DataFrame, apart: DataFrame, open_buckets: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """Links between components, by their labels, that tiles of the open buckets find, and the table's path."""
    left, left_path = stored(narrow(_by_bucket(apart, open_buckets)), "minhash-left")
    sets, sets_path = _sets(docs, nodes, left.select("node"))
    paths, found, large = [left_path, sets_path], [], left.where("tiles > 1").count()
    left = left.select("bucket", "band", "node", "root", "n_shingles", "members", "tiles")
    while large:
        parts, links, part_paths = _parted(left.where("tiles > 1"), sets, percent)
        left, before, large = left.where("tiles = 1").unionByName(parts), large, parts.where("tiles > 1").count()
        found.append(links)
        paths += part_paths
        if 2 * large > before:
            break
    tiles = (
        left.drop("members").join(nodes.select("node", "bands", "sketch"), "node")
        .withColumn("own", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
        .withColumn("ti", F.least("own", "other")).withColumn("tj", F.greatest("own", "other"))
        .withColumn("part", F.when(F.col("own") == F.col("ti"), 0).otherwise(1))
        .join(sets, "node").select("bucket", "ti", "tj", "node", "root", "n_shingles", "part", "band", "bands", "sketch", "shingles"))
    more = tiles.repartition("bucket", "ti", "tj").sortWithinPartitions("bucket", "ti", "tj").mapInArrow(_tiler(percent), "a long, b long")
    for links in found:
        more = more.unionByName(links)
    more, path = stored(more, "minhash-more")
    discard(docs.sparkSession, *paths)
    return more, path


def _parted(places: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """``places`` of large buckets in other buckets that together hold every pair still to be looked at, links of labels found on the way, and the paths that both read.

    Every bucket has a centre c, the member with most neighbours in large buckets, and all
    of its members x are compared with it.  Two sets x and y that link have at least
    percent of x in common with y.  Where all of that is in c and c is no larger than y, x
    links with c: |x & c| >= |x & y| and |c| <= |y|.  So of two sets that link, and do not
    both belong to the component of c, either

    * both have a shingle in common that c has not.  At least ``k``, percent of |x| less
      |x & c|, of them are shared, so it is enough to meet in all but ``k - 1`` of those
      that several components have, the rarest first; or
    * one is outside the component of c, one is smaller than c, and percent of each is in c.
    """
    weights = places.groupBy("node").agg(F.sum("members").alias("weight"))
    centres = places.join(weights, "node").groupBy("bucket").agg(F.first("members").alias("members"), F.max(F.struct("weight", "node", "root")).alias("of"))
    centres, centres_path = stored(narrow(centres.select("bucket", "members", F.col("of.node").alias("a"), F.col("of.root").alias("root_a"))), "minhash-centres")
    pairs = _by_bucket(places.drop("members"), centres)
    pairs, pairs_path = stored(narrow(pairs.where("node <> a").select("a", F.col("node").alias("b"), "root_a", F.col("root").alias("root_b")).distinct()), "minhash-around")
    names = "a long, b long, root_a long, root_b long, n_shingles long, both long, linked boolean, smaller boolean, own array<long>"
    measured, path = stored(_met(pairs, sets).select("a", "b", "root_a", "root_b", "of_a", "of_b").mapInArrow(_differ(percent), names), "minhash-differ")
    links = measured.where("linked and root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    members = measured.withColumnRenamed("b", "node").withColumn("root", F.when(F.col("linked"), F.col("root_a")).otherwise(F.col("root_b"))).withColumn("k", F.ceil(F.lit(percent) * F.col("n_shingles") / 100) - F.col("both"))

    own = members.select("a", "node", "root", "n_shingles", "k", F.explode("own").alias("of"))
    shared, shared_path = stored(narrow(own.groupBy("a", "of").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("members")).where("x <> y").select(F.xxhash64("a", "of").alias("bucket"), "members")), "minhash-shared")
    own = _by_bucket(own.withColumn("bucket", F.xxhash64("a", "of")), shared)
    of_one = Window.partitionBy("a", "node")
    own = own.withColumn("n", F.count("*").over(of_one)).withColumn("at", F.row_number().over(of_one.orderBy("members", "bucket")))
    own = own.where("at <= n + 1 - greatest(k, 1)").select("bucket", "node", "root", "n_shingles")

    outside = F.col("root") != F.col("root_a")
    loose = members.where("k <= 0").where(outside | F.col("smaller")).withColumn("bucket", F.xxhash64("a"))
    both, both_path = stored(narrow(loose.groupBy("bucket").agg(F.count("*").alias("members"), F.max(outside).alias("x"), F.max("smaller").alias("y")).where("x and y").select("bucket", "members")), "minhash-both")
    loose = _by_bucket(loose, both).select("bucket", "node", "root", "n_shingles")

    parts, parts_path = stored(narrow(own.unionByName(loose)), "minhash-parts")
    open_buckets, open_path = stored(narrow(_open(parts)), "minhash-open")
    parts = _by_bucket(parts.withColumn("band", F.lit(-1)), open_buckets).select("bucket", "band", "node", "root", "n_shingles", "members", "tiles")
    parts, left_path = stored(narrow(parts), "minhash-left")
    discard(places.sparkSession, centres_path, pairs_path, shared_path, both_path, parts_path, open_path)
    return parts, links, [path, left_path]


def _by_bucket(places: DataFrame, buckets: DataFrame) -> DataFrame:
    """``places`` joined to ``buckets`` (bucket, members and more); those of hot buckets by broadcast, the others by shuffle."""
    total, most = buckets.agg(F.sum("members"), F.max("members")).first()
    least = max(TILE, int((total or 0) * HOT))
    if (most or 0) <= least:
        return places.join(buckets, "bucket")
    # Buckets of so many members are fewer than 1 / HOT, some 300 KB.
    hot = F.broadcast(buckets.where(F.col("members") > least).withColumn("_hot", F.lit(True)))
    known = places.join(hot, "bucket", "left")
    own = known.where("_hot").drop("_hot")
    rest = known.where("_hot is null").select(*places.columns).join(buckets.where(F.col("members") <= least), "bucket")
    return own.unionByName(rest)


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, str]:
    """(node, shingles) of the ``wanted`` nodes, from the texts that stand for them, and the table's path."""
    own = nodes.join(wanted.distinct(), "node", "left_semi").select("node", F.col("text_of.text_key").alias("key"), F.col("text_of.doc_id").alias("id"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    found = texts.join(own, (texts.text_key == own.key) & texts.doc_id.eqNullSafe(own.id)).select("node", "text")
    return stored(found.mapInArrow(_full_sets, "node long, shingles binary").dropDuplicates(["node"]), "minhash-sets")


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """The pairs (a, b) of nodes whose full sets meet the threshold, and the table's path."""
    pairs, pairs_path = stored(narrow(pairs), "minhash-pairs")
    sets, sets_path = _sets(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    links, path = stored(_met(pairs, sets).select("a", "b", "of_a", "of_b").mapInArrow(_confirmer(percent), "a long, b long"), "minhash-links")
    discard(docs.sparkSession, pairs_path, sets_path)
    return links, path


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b and more) with the shingles of both, of_a and of_b.

    Pairs of a hub with very many spokes are dealt to several tasks, each with the hub's set; such hubs are fewer than 1 / HOT.
    """
    least = max(TILE, int(pairs.count() * HOT))
    hot = F.broadcast(pairs.groupBy("a").count().where(F.col("count") > least).select("a", F.lit(True).alias("hot")))
    dealt = pairs.join(hot, "a", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.hash("b"), F.lit(SALTS))).otherwise(0)).drop("hot")
    of_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")).join(hot, "a", "left")
    of_a = of_a.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0)))).drop("hot")
    return dealt.join(of_a, ["a", "salt"]).join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one stands for each component; columns as they were.

    Kept is the row of the component's smallest doc_id; of several rows with that
    id in it, the one whose text has the smallest hash, and of equal texts one.
    Rows without words stand for themselves.
    """
    marked, paths = _marked(docs, percent)
    marked, marked_path = stored(narrow(marked), "minhash-marked")
    discard(docs.sparkSession, *paths)
    alone = marked.where("node is null").select("doc_id", "text_key").distinct()
    first = marked.where("node is not null and doc_id <=> component_id").groupBy("node", "component_id").agg(F.min(F.struct("text_key", "doc_id")).alias("of"))
    first = first.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("node")).alias("group")).agg(F.min("of").alias("of")).select("of.doc_id", "of.text_key")
    chosen, _ = stored(narrow(alone.withColumn("many", F.lit(True)).unionByName(first.withColumn("many", F.lit(False)))), "minhash-chosen")
    key = "_minhash_text_key"
    keyed = docs.withColumn(key, F.xxhash64("text"))
    chosen = chosen.select(F.col("doc_id").alias("_minhash_id"), F.col("text_key").alias("_minhash_of"), F.col("many").alias("_minhash_many"))
    rows = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("_minhash_id")) & (F.col(key) == F.col("_minhash_of")))
    repeated = marked.where("node is not null").groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    discard(docs.sparkSession, marked_path)
    if repeated:
        # Only where whole rows repeat: rows without words all stay, of others one a key.
        rows = rows.where("_minhash_many").unionByName(rows.where("not _minhash_many").dropDuplicates(["_minhash_of"]))
    return rows.drop(key, "_minhash_id", "_minhash_of", "_minhash_many")
