"""The rate limiter that decides in order of time: late events, leaving state, and a restart."""

from __future__ import annotations

import random

import pytest

from sagebeam.operators import ordered
from sagebeam.operators import revisions as operators
from sagebeam.streaming import rate_limit, revisions

EVENTS = "key string, event_id long, seconds double"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, was)


def decisions(frame):
    return {r["event_id"]: (r["key"], r["window_start"], r["count"], r["accepted"]) for r in frame.collect()}


def test_order_of_arrival_late_events_state_and_restart(rocks, tmp_path):
    spark, rng = rocks, random.Random(5)
    events = [(f"k{rng.randrange(3)}", i, 1000.0 + 40 * i + rng.randrange(30)) for i in range(60)]
    # Neighbours change places within the delay; files come one by one.
    arrival = [e for i in range(0, 60, 4) for e in rng.sample(events[i : i + 4], 4)]
    late = ("k0", 900, 1000.0)
    batches = [arrival[:20], arrival[20:40], [late, *arrival[40:]], [("tick", 1000, 90_000.0)], [("tick", 1001, 180_000.0)], [("tick", 1002, 270_000.0)]]
    place = str(tmp_path / "in")
    frame = spark.createDataFrame(events + [("tick", 1000 + i, 90_000.0 * (i + 1)) for i in range(2)], EVENTS)
    want = decisions(ordered.rate_limited(frame, "key", "seconds", "event_id", 600, 3))

    def run(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(place)
        stream = spark.readStream.schema(EVENTS).parquet(place)
        query = rate_limit.limited_in_order(stream, 600, 3, "5 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").start()
        query.processAllAvailable()
        progress = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        query.stop()  # every batch of files is another run from the checkpoint
        return progress

    dropped, kept = 0, []
    for rows in batches:
        progress = run(rows)
        dropped += sum(p["numRowsDroppedByWatermark"] for p in progress)
        kept.append(progress[-1]["numRowsTotal"] if progress else None)
    assert decisions(spark.read.schema(rate_limit.OUTPUT).parquet(str(tmp_path / "out"))) == want
    assert dropped == 1
    # At the end only the last tick waits; all keys before it have left.
    assert kept[-1] is not None and kept[-1] <= 4 < max(k for k in kept if k is not None)


ANALYSIS = "analysis_id string, supersedes_analysis_id string, response string"


def test_store_of_analyses_takes_no_row_twice_and_overwrites_none(spark, tmp_path):
    place, store = str(tmp_path / "in"), str(tmp_path / "store")
    append = revisions.appender(store, ANALYSIS, reviewed=lambda s: s.createDataFrame([("a1",)], "id string"))

    def run(rows):
        spark.createDataFrame(rows, ANALYSIS).coalesce(1).write.mode("append").parquet(place)
        query = spark.readStream.schema(ANALYSIS).parquet(place).writeStream.foreachBatch(append).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()

    all_rows = lambda what: sorted(tuple(r)[:-1] for r in revisions.kept(spark, store, ANALYSIS, what).collect())
    run([("a1", None, "first"), ("a2", "a1", "second"), ("a2", "a1", "second"), ("x1", "lost", "?"), ("x2", "x1", "?")])
    run([("a1", None, "changed"), ("a2", "a1", "other"), ("a2", "a1", "second"), ("a3", "a2", "third"), ("b", None, "1"), ("b", None, "2"), ("o1", "o2", ""), ("o2", "o1", ""), ("s", "s", ""), (None, None, "")])
    want = [("a1", None, "first"), ("a2", "a1", "second"), ("a3", "a2", "third")]
    assert all_rows("analyses") == want
    reasons = {(r["analysis_id"], r["response"]): r["reason"] for r in revisions.kept(spark, store, ANALYSIS, "refused").collect()}
    assert reasons == {("x1", "?"): revisions.UNKNOWN, ("x2", "?"): revisions.UNKNOWN, ("a1", "changed"): revisions.REVIEWED, ("a2", "other"): revisions.EXISTS,
                       ("b", "1"): revisions.TWICE, ("b", "2"): revisions.TWICE, ("o1", ""): revisions.UNKNOWN, ("o2", ""): revisions.UNKNOWN, ("s", ""): revisions.UNKNOWN, (None, ""): revisions.UNKNOWN}
    # A batch that failed after its writes runs again.
    append(spark.createDataFrame([("a3", "a2", "third")], ANALYSIS), 1)
    assert all_rows("analyses") == want
    chain = operators.chains(revisions.kept(spark, store, ANALYSIS), "analysis_id", "supersedes_analysis_id").first()
    assert (chain["root"], chain["head"], chain["length"], chain["n_heads"]) == ("a1", "a3", 3, 1)


def test_lineage_of_long_chains_forks_and_circles(spark):
    rows = [(i, i - 1 if i % 100 else None) for i in range(300)] + [(1000, 50), (1001, 50), (1002, 1001), (2000, 1999)]
    got = {r["id"]: (r["root"], r["depth"], r["is_head"]) for r in operators.lineage(spark.createDataFrame(rows, "id long, before long"), "id", "before").collect()}
    befores = {b for _, b in rows}
    want = {i: (i - i % 100, i % 100, i not in befores) for i in range(300)} | {1000: (0, 51, True), 1001: (0, 51, False), 1002: (0, 52, True), 2000: (2000, 0, True)}
    assert got == want
    circle = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, None)], "id long, before long")
    with pytest.raises(ValueError, match="circle"):
        operators.lineage(circle, "id", "before")
    assert [r["id"] for r in operators.lineage(circle, "id", "before", circles=True).collect()] == [4]
    assert operators.lineage(circle.limit(0), "id", "before").count() == 0
