"""The stored index of words by Hamming distance against comparison with all."""

from __future__ import annotations

import random

from sagebeam.operators import metric_index


def near(rng, word, bits):
    return word ^ sum(1 << b for b in rng.sample(range(64), bits))


def signed(word):
    return word - (1 << 64) if word >> 63 else word


def test_probes_find_what_a_comparison_with_all_finds(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    old = [rng.getrandbits(64) for _ in range(400)] + [0, (1 << 64) - 1]
    old += [near(rng, rng.choice(old), rng.randrange(1, 9)) for _ in range(300)]
    later = [near(rng, rng.choice(old), rng.randrange(0, 5)) for _ in range(100)]
    new = [near(rng, rng.choice(old + later), rng.randrange(0, 7)) for _ in range(300)] + [rng.getrandbits(64) for _ in range(50)]
    frame = lambda words: spark.createDataFrame([(signed(w),) for w in words] * 2 + [(None,)], "word long").repartition(3)
    want = lambda store, radius: {(signed(a), signed(b), (a ^ b).bit_count()) for a in new for b in store if (a ^ b).bit_count() <= radius}
    got = lambda radius: [tuple(r) for r in metric_index.probe(frame(new), path, radius).collect()]
    path = str(tmp_path / "index")
    monkeypatch.setattr(metric_index, "BLOCK", 40)
    monkeypatch.setattr(metric_index, "PROBES", 30)
    metric_index.build(frame(old), path)
    files = sorted(p.name for p in (tmp_path / "index" / "blocks").glob("*.parquet"))
    for radius in (0, 4, 9):
        assert len(got(radius)) == len(set(got(radius))) and set(got(radius)) == want(old, radius)
    metric_index.extend(frame(later), path)
    metric_index.extend(frame(later), path)  # nothing is added twice
    assert set(files) <= {p.name for p in (tmp_path / "index" / "blocks").glob("*.parquet")}
    assert sorted(got(4)) == sorted(want(old + later, 4))


def test_most_cells_are_not_opened():
    import numpy as np

    rng = np.random.default_rng(1)
    words = rng.integers(-(2**63), 2**63 - 1, 40_000)
    pivots = words[:200]
    d = metric_index.distances(words, pivots)
    reach = np.array([d[d.argmin(axis=1) == c, c].max() for c in range(200)], dtype=np.int32)
    assert (metric_index.distances(words[:500], pivots) <= reach[None] + 4).mean() < 0.5


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "word long")
    metric_index.build(none, str(tmp_path / "i"))
    metric_index.extend(none, str(tmp_path / "i"))
    assert metric_index.probe(spark.createDataFrame([(1,)], "word long"), str(tmp_path / "i")).count() == 0
