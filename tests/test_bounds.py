"""What a task holds does not grow with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagebeam.operators import dedup, metric_index, validation
from sagebeam.operators.shared import BATCH_BYTES, BATCH_ROWS
from sagebeam.plans import curation


def test_hashed_texts_come_in_bounded_batches(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert curation._hashed(spark, "/root/testdata/sf0.001").agg(F.count("bits")).first()[0] == 200
        rows, size = (int(spark.conf.get(k).rstrip("b")) for k in before)
        assert rows <= BATCH_ROWS and size <= BATCH_BYTES
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_edges_are_the_same_from_as_many_tasks_as_the_words_need(spark, monkeypatch):
    classes = spark.range(600).select((F.col("id") * 7).alias("word"))
    whole = dedup.hamming_edges(classes)
    monkeypatch.setattr(dedup, "KEYS_A_TASK", 100)
    found = dedup.hamming_edges(classes)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect())) and whole.limit(1).count() == 1
    assert "hashpartitioning(choice#" in (plan := found._jdf.queryExecution().toString()) and ", 30), REPARTITION_BY_NUM" in plan  # 600 words under 5 choices


def test_orphans_of_many_parents_are_dealt_to_many_tasks(spark, monkeypatch):
    rows = spark.range(500).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 100).alias("ref"))
    parents = spark.range(400).select((F.col("id") % 95).alias("p"))
    want = sorted(str(i) for i in range(500) if i % 10 and i % 100 >= 95)
    for keys, plan in ((500_000, "BroadcastHashJoin"), (10, ", 10), REPARTITION_BY_NUM")):
        monkeypatch.setattr(validation, "BROADCAST_KEYS", keys)
        monkeypatch.setattr(validation, "ROWS_A_TASK", 50)
        found = validation.orphans(rows, "rows", "id", "ref", parents, "p")
        assert sorted(r["row_key"] for r in found.collect()) == want and plan in found._jdf.queryExecution().toString()


def test_the_metric_index_reads_bounded_batches(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for work in (lambda: metric_index.build(words, str(tmp_path)), lambda: metric_index.probe(words, str(tmp_path)).count()):
            words = spark.range(50).select(F.col("id").alias("word"))
            spark.conf.set(key, "10000")
            work()
            assert int(spark.conf.get(key)) <= BATCH_ROWS
    finally:
        spark.conf.set(key, before)
