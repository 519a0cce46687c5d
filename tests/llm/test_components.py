"""Components and what joins them: few rounds, few plans, the same labels."""

from __future__ import annotations

import random
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sagebeam.llm import frames, langid, learning, minhash


def least_reachable(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {x: find(x) for x in up}


def edges_of(seed):
    rng = random.Random(seed)
    return [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000, 1000 + i) for i in range(1, 1200)] + [(2000 + i, 2001 + i) for i in range(40)]


@pytest.mark.parametrize("stars", [False, True])
def test_labels_are_the_smallest_nodes(spark, stars):
    """With and without a node that has more than a thousand edges."""
    edges = [(a, b) for a, b in edges_of(3) if a != b and (stars or a != 1000)]
    got, _ = frames.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == least_reachable(edges)


def test_nothing_to_join_needs_no_round(spark, monkeypatch):
    """No edge, no round; and without open buckets no second search for components."""
    made = []
    whole = frames.stored
    monkeypatch.setattr(frames, "stored", lambda df, name: made.append(name) or whole(df, name))
    got, _ = frames.components(spark.createDataFrame([], "a long, b long"), "none")
    assert got.count() == 0 and made.count("none-labels") == 1
    asked = []
    of = minhash.components
    monkeypatch.setattr(minhash, "components", lambda edges, name: asked.append(name) or of(edges, name))
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "some other text of six words")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()) == [(1, 1), (2, 1), (3, 3)] and asked == ["minhash-first"]


def test_labels_of_components_are_joined(spark, monkeypatch):
    """With bands of one value unlike sets share buckets, whose hub is like few of them; what the tiles join is as brute force has it."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(12)]
    texts = [" ".join([*b[:i], f"z{i}", *b[i + 1 :]]) for b in base for i in (7, 30, 52)]
    texts += [" ".join(base[k % 12][:30] + base[(k + 1) % 12][30:]) for k in range(12)]
    asked = []
    of = minhash.components
    monkeypatch.setattr(minhash, "components", lambda edges, name: asked.append(name) or of(edges, name))
    monkeypatch.setattr(minhash, "rows_of_bands", lambda percent: 1)
    monkeypatch.setattr(minhash, "TILE", 4)
    monkeypatch.setattr(minhash, "SIGMAS", 40.0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 60).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])]
    want = {i: i for i in range(len(sets))} | least_reachable(near)
    assert got == want and len(set(want.values())) > 2 and asked == ["minhash-first", "minhash-final"]


def near_copies(n, seed, vocabulary):
    """Copies of a text with some words replaced or cut off, of a second one that has half of it, and of families that replaced a passage alike."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    starts = [base, base[:60] + [f"u{i}" for i in range(55)], *([*base[:i], *(f"f{i}-{j}" for j in range(9)), *base[i + 9 :]] for i in (20, 70))]
    out = [" ".join(base)]
    for _ in range(n):
        words = list(rng.choice(starts))
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(vocabulary)}"
        out.append(" ".join(words[: len(words) - rng.choice([0, 0, 0, 5, 14, 25])]))
    return out


@pytest.mark.parametrize(("percent", "long", "vocabulary"), [(80, 5, 10**6), (80, 2, 3), (60, 2, 40)])
def test_large_buckets_are_parted_without_loss(spark, monkeypatch, percent, long, vocabulary):
    """Families of near copies around several texts, in buckets of many tiles: the components are those of brute force."""
    monkeypatch.setattr(minhash, "TILE", 6)
    monkeypatch.setattr(minhash, "SIGMAS", 40.0)
    monkeypatch.setattr(minhash, "rows_of_bands", lambda _: long)
    passes, of = [], minhash._parted
    monkeypatch.setattr(minhash, "_parted", lambda *a: passes.append(1) or of(*a))
    texts = near_copies(150, percent + vocabulary, vocabulary)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = {i: i for i in range(len(sets))} | least_reachable(near)
    assert got == want and len(set(want.values())) > 1 and passes


def test_tiles_meet_no_more_rows_than_buckets_hold(spark, monkeypatch):
    """Near copies of a text in buckets of many tiles: the rows that meet in tiles are fewer than the places in buckets, 33 a text."""
    monkeypatch.setattr(minhash, "TILE", 16)
    of = minhash._tiler

    def met(n):
        rows = spark.sparkContext.accumulator(0)

        def counted(percent):
            run = of(percent)

            def seen(batches):
                for batch in batches:
                    rows.add(batch.num_rows)
                    yield batch

            return lambda batches: run(seen(batches))

        monkeypatch.setattr(minhash, "_tiler", counted)
        rng = random.Random(8)
        base = [f"w{i}" for i in range(150)]
        texts = [" ".join(f"v{rng.randrange(10**6)}" if i in at else w for i, w in enumerate(base)) for at in [[], *([rng.randrange(150) for _ in range(rng.randrange(1, 6))] for _ in range(n))]]
        assert minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == n + 1
        return rows.value

    assert 0 < met(600) <= 33 * 601


def test_narrow_tables_have_few_files(spark):
    """Components of many shuffle partitions leave a few files a core."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 10).alias("b"))
        found, (path,) = frames.components(edges)
        assert sorted(map(tuple, found.collect())) == [(i, i - i % 10) for i in range(2000)]
        assert len(list(Path(path.removeprefix("file://")).glob("*.parquet"))) <= frames.NARROW_FILES * spark.sparkContext.defaultParallelism < 60
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_features_hold_little_beside_the_matrix():
    texts = pa.chunked_array([pa.array(["Ein Satz, und noch einer. " * 60] * n, pa.string()) for n in (900, 0, 1100)])

    def peak(work):
        tracemalloc.start()
        try:
            return work(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    rows, most = peak(lambda: sum(b - a for a, b, _ in learning.ngrams(texts.chunk(2), learning.LETTERS, langid.DIMS)))
    assert rows == 1100 and most < 24 << 20
    x, most = peak(lambda: langid.features(texts))
    assert x.shape == (2000, langid.DIMS) and np.allclose(x, x[0]) and abs(float(np.square(x[0]).sum()) - 1) < 1e-5
    assert most < x.nbytes + (24 << 20)
