"""Each stage of the pipeline against what it should keep of its own input."""

from __future__ import annotations

import corpus_pipeline as pipeline
import pytest
from compare import SF
from pyspark.sql import functions as F
from test_llm_operators import brute_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = docs.orderBy("doc_id").collect()
    near = pipeline.near_duplicates(spark, docs, SF)
    assert near.columns == COLUMNS
    groups = brute_groups([r["text"] for r in texts], pipeline.NEAR)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(texts[i]["doc_id"] for i in set(groups))
    language = pipeline.language(spark, docs, SF)
    assert language.columns == COLUMNS and language.count() >= 0.99 * len(texts)
    clean = pipeline.benchmark(spark, docs, SF)
    from sagebeam.llm import decontaminate

    hit = decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
    assert clean.columns == COLUMNS and clean.count() == len(texts) - hit


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e f", "en", "s", 1)] * 3 + [(2, "a b c d e f", "en", "s", 1), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (None, "x y z", "en", "s", 0), (None, "x y z", "en", "s", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("node", F.lit(1))
    got = sorted((r["doc_id"] or 0, r["text"]) for r in pipeline.near_duplicates(spark, frame, SF).collect())
    assert got == [(0, "x y z"), (1, "a b c d e f"), (3, ""), (3, "")]


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_take_empty_input(spark, name):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(pipeline.STAGES)[name](spark, empty, SF).count() == 0


def test_stages_take_odd_rows(spark, odd):
    """Nulls, empty and very long texts, repeated rows and clashing columns; each stage by what it says that it keeps."""
    stages = {name: stage(spark, odd, SF) for name, stage in pipeline.STAGES}
    kept = {name: sorted((r["doc_id"] or 0) for r in f.collect()) for name, f in stages.items()}
    assert all(f.columns == odd.columns for name, f in stages.items() if name != "mix") and stages["mix"].columns == [*odd.columns, "_taken"]
    assert kept["language"] == [0, 4, 4, 8, 9]
    assert kept["near_duplicates"] == [0, 1, 2, 3, 4, 7, 8, 9]
    assert kept["benchmark"] == sorted((r["doc_id"] or 0) for r in odd.collect())
    assert set(kept["toxicity"]) <= {0, 1, 2, 3, 4, 7, 8, 9} and set(kept["mix"]) <= {0, 4, 7, 8, 9}


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == [*COLUMNS, "taken"] and out.where("taken <= 0").count() == 0 and out.count() > 0
