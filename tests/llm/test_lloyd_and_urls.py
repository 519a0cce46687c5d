"""Clustering, vector codes and URL filters against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from compare import SF
from pyspark.sql import functions as F

from sagebeam.llm import centroids, codes, frames, lloyd, queries, urls

VECTORS = "vec_id long, embedding array<double>, label int"


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floors(v, scale):
    return [math.floor(float(x) * scale) for x in v]


def nearest(point, entries):
    d = [sum((a - b) ** 2 for a, b in zip(point, e, strict=True)) for e in entries]
    return d.index(min(d)), min(d)


def plain_lloyd(points, entries, rounds):
    for _ in range(rounds):
        own = [nearest(p, entries)[0] for p in points]
        members = [[p for p, k in zip(points, own, strict=True) if k == j] for j in range(len(entries))]
        entries = [[sum(t) // len(m) for t in zip(*m, strict=True)] if m else e for m, e in zip(members, entries, strict=True)]
    return entries, [nearest(p, entries) for p in points]


def sha(entries):
    return hashlib.sha256(",".join(str(v) for e in entries for v in e).encode()).hexdigest()


def plain_clusters(rows, dims, k=8, rounds=10, scale=1024):
    kept = [(i, floors(v, scale)) for i, v, _ in rows if sound(v) and len(v) == dims]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    entries, own = plain_lloyd([p for _, p in kept], [p for _, p in order[:k]], rounds)
    inertia = {j: sum(d for n, d in own if n == j) for j in range(k)}
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha([entries[n]])) for (i, _), (n, d) in zip(kept, own, strict=True)), key=repr)


def plain_codes(rows, parts=8, k=16, rounds=6, scale=4096):
    out = []
    kept = [(i, floors(v, scale), label) for i, v, label in rows if sound(v)]
    for dims in {len(v) for _, v, _ in kept}:
        own = [r for r in kept if len(r[1]) == dims]
        first = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:k]
        code, error, books = [""] * len(own), [0] * len(own), []
        for a, b in lloyd.cuts(dims, parts):
            entries, near = plain_lloyd([v[a:b] for _, v, _ in own], [v[a:b] for _, v, _ in first], rounds)
            books += entries
            for i, (n, d) in enumerate(near):
                code[i], error[i] = code[i] + f"{n:02x}", error[i] + d
        out += [(i, label, c, e, sha(books)) for (i, _, label), c, e in zip(own, code, error, strict=True)]
    by_label = {label: sum(r[3] for r in out if r[1] == label) for label in {r[1] for r in out}}
    return sorted(((i, c, e, by_label[label], h) for i, label, c, e, h in out), key=repr)


CLUSTER = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
CODE = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def collected(frame, columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def test_queries_by_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert collected(queries.op11_centroids(spark, SF), CLUSTER) == plain_clusters(rows, 64)
    assert collected(queries.op13_codes(spark, SF), CODE) == plain_codes(rows)


@pytest.mark.parametrize("size", [1.0, 1e4, 1e9, 1e13])
def test_ties_repeats_and_all_magnitudes(spark, monkeypatch, size):
    """Few different values, so that distances tie; magnitudes for each exact type of integers; several blocks."""
    rng = random.Random(int(size))
    monkeypatch.setattr(lloyd, "BLOCK", 7)
    rows = [(i // 2 if i % 9 else None, [rng.choice([-1, 0, 0.5, 1]) * size / 1024 for _ in range(8)], rng.choice([None, 1, 2])) for i in range(60)]
    rows += rows[:5] + [(100, None, 1), (101, [1.0] * 7 + [None], 1), (102, [1.0] * 7 + [math.nan], 1), (103, [math.inf] * 8, 1), (104, [], 1), (105, [1.0] * 5, None)]
    frame = spark.createDataFrame(rows, VECTORS).withColumn("cluster", F.lit("clash")).withColumn("dims", F.lit("clash")).repartition(3)
    fits = lambda rows_, at: [tuple(None if i in at and isinstance(v, int) and v >= 2**63 else v for i, v in enumerate(r)) for r in rows_]
    assert collected(centroids.cluster(frame, 5, 4, dims=8), CLUSTER) == sorted(fits(plain_clusters(rows, 8, 5, 4), (2, 3, 4)), key=repr)
    got, want = collected(codes.compress(frame, 4, 3, 3), CODE), plain_codes(rows, 4, 3, 3)
    # Where one error of a label does not fit, its sum does not either.
    lost = {r[3] for r in want if r[2] >= 2**63}
    assert got == sorted((tuple(None if (i == 2 and v >= 2**63) or (i == 3 and (v >= 2**63 or v in lost)) else v for i, v in enumerate(r)) for r in want), key=repr)


def test_bounds_save_work_and_never_change_a_result():
    rng = np.random.default_rng(2)
    heads = rng.integers(-1000, 1000, (12, 6))
    x = (heads[rng.integers(0, 12, 3000)] + rng.integers(-40, 40, (3000, 6))).astype(np.float64)
    book = lloyd.Codebook([[int(v) for v in row] for row in x[:12]])
    groups = centroids.group_centroids(book.entries, 3)
    near = upper = lower = None
    heaps, measured, scanned = None, [], []
    twin = lloyd.Codebook(book.entries)
    for _ in range(12):
        was = near
        near, upper, lower, n = centroids.assign(x, book, groups, near, upper, lower)
        heaps, popped, _ = codes.rescan(x, twin, heaps)
        entry = np.empty(len(x), dtype=int)
        entry[heaps.parts] = heaps.entries()
        want = lloyd.table_of(x, book.matrix(x)).argmin(axis=1)
        assert (near == want).all() and (entry == want).all()
        ends = np.cumsum(heaps.sizes)
        assert all((np.diff(heaps.keys[b - k : b]) >= 0).all() for b, k in zip(ends, heaps.sizes, strict=True))
        true = np.sqrt(lloyd.table_of(x, book.matrix(x)))
        assert (upper >= true[np.arange(len(x)), near]).all()
        for g, members in enumerate(groups):
            others = np.where(members[None] == near[:, None], np.inf, true[:, members]).min(axis=1)
            assert (lower[:, g] <= others).all()
        measured.append(n)
        scanned.append(len(popped))
        flat = lloyd.changes(x, was, near, 12)
        for b in (book, twin):
            b.add({i: int(v) for i, v in enumerate(flat)})
            b.move()
    assert measured[-1] < 0.2 * x.size / 6 * 12 and scanned[-1] < 0.2 * len(x)


def test_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert centroids.cluster(none).collect() == [] and codes.compress(none).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, [0.5] * 3, 1)], VECTORS)).collect() == []
    one = spark.createDataFrame([(7, [0.5] * 64, None)], VECTORS)
    assert [tuple(r)[:5] for r in centroids.cluster(one).collect()] == [(7, 0, 0, 0, 0)] and [tuple(r)[:4] for r in codes.compress(one).collect()] == [(7, "00" * 8, 0, 0)]


PAGES = "page_id long, url string"


def plain_verdicts(pages, rules, listed):
    def cut(url):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        at = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
        return lower, rest[at:].split("?")[0].split("#")[0]

    def canonical(url):
        h, p = cut(url)
        for lead in ("www.", "m."):
            if h.startswith(lead):
                h = h[len(lead) :]
                break
        p = p.rstrip("/")
        for end in (".html", ".htm"):
            if p.endswith(end):
                p = p[: -len(end)]
                break
        return h and h + p.removesuffix("/index").rstrip("/") if not p.endswith("/index") else h + p[: -len("/index")]

    known, out = {canonical(u) for u in listed if u and cut(u)[0]}, []
    for page, url in pages:
        h, p = cut(url)
        fit = [(len(rh + rp), len(rh), v == "block", rh + rp, v) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        out.append((page, h, p, max(fit)[3] if fit else None, max(fit)[4] if fit else "block" if h and canonical(url) in known else "allow"))
    return sorted(out, key=repr)


def test_urls_by_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    hosts = ["a.org", "A.Org", "x.a.org", "ba.org", "org", "www.b.com", "m.b.com", "b.com:80", "com", "", "é.net"]
    paths = ["", "/", "/en/", "/en/1", "/En/1", "/index.html", "/page.html", "/page", "/page/", "//", "/a b"]
    urls_ = [rng.choice(["http", "https"]) + "://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?q=/en/", "#/en/", "?u=http://com/"]) for _ in range(300)]
    pages = [(i // 2, u) for i, u in enumerate(urls_)] + [(None, None), (None, "no scheme"), (1, ""), (5, "http://b.com/\nnew line"), *[(9, "http://m.b.com/page")] * 40]
    rules = [("block", "org", "/"), ("allow", "a.org", "/en/"), ("block", "a.org", "/en/1"), ("allow", "com", "/page"), ("allow", "b.com", ""), ("block", "b.com", ""), ("allow", "é.net", "/")]
    listed = ["http://b.com/", "https://www.com/page.html", None, "junk", "http://ba.org/page", *(f"http://far{i}.net/x" for i in range(200))]
    frame = spark.createDataFrame(pages, PAGES).withColumn("verdict", F.lit("clash")).withColumn("key", F.lit("clash")).repartition(3)
    of = lambda: urls.judge(frame, urls.rule_table(spark, rules), spark.createDataFrame([(u,) for u in listed], "url string"))
    columns = ("page_id", "host", "path", "rule", "verdict")
    want = plain_verdicts(pages, rules, listed)
    assert collected(of(), columns) == want
    # Tables too large to broadcast meet by shuffle, hot keys by broadcast; a block that is full lets all through to the exact join.
    monkeypatch.setattr(frames, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(frames, "HOT_ROWS", 10)
    monkeypatch.setattr(urls, "KEYS", 10_000)
    assert collected(of(), columns) == want


def test_urls_without_rules_lists_or_pages(spark):
    rules, pages = urls.rule_table(spark, urls.RULES), spark.createDataFrame([(1, "http://a.org/x")], PAGES)
    no_url = spark.createDataFrame([], "url string")
    assert urls.judge(pages.limit(0), rules, no_url).count() == 0
    assert [tuple(r) for r in urls.judge(pages, rules.limit(0), no_url).collect()] == [(1, "a.org", "/x", None, "allow", False)]
    assert [tuple(r) for r in urls.judge(pages, rules.limit(0), pages.select("url")).collect()] == [(1, "a.org", "/x", None, "block", True)]


def test_filter_keeps_every_listed_key_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = -(-20_000 // urls.KEYS)
    filters = urls.bloom(keys, blocks)
    asked = spark.range(100_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") < 20_000).alias("own")).withColumn("block", urls._block(F.col("key"), blocks)).join(filters, "block")
    for i in range(urls.WORDS):
        asked = asked.where(F.col(f"w{i}").bitwiseAND(urls._bit("key", i)) != 0)
    assert asked.where("own").count() == 20_000 and asked.where("not own").count() < 400
