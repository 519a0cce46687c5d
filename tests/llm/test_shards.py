"""Classifiers learn from all labelled rows, in shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagebeam.llm import langid, learning, toxicity

SF = "/root/testdata/sf0.01"


def test_every_row_is_dealt_and_rare_strata_are_in_all_shards(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 7, "rare").otherwise("common").alias("kind"))
    got = learning.dealt(rows, "kind", {"rare": 3, "common": 2997}, 300).toPandas()
    assert sorted(got["doc_id"][got["copy"] == 0]) == list(range(3000)) and set(got["shard"]) == set(range(10))
    assert (got[got["kind"] == "rare"].groupby("shard").size() == 3).all() and got["copy"][got["kind"] == "common"].max() == 0


def test_words_of_any_labelled_row_are_learned(spark):
    """Each toxic word is in few rows, so that a sample of a hundred would miss most of them."""
    text = F.concat(F.lit("plain words and "), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("bad"), (F.col("doc_id") % 40).cast("string"), F.lit("x"))).otherwise(F.lit("nice")), F.lit(" things "), (F.col("doc_id") % 11).cast("string"))
    docs = spark.range(2400).select(F.col("id").alias("doc_id")).select("doc_id", text.alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    got = toxicity.toxic(docs, labels, 100).where("held_out").toPandas()
    assert len(got) > 500 and (got["predicted"] == (got["doc_id"] % 3 == 0)).mean() > 0.98


def test_averaged_machines_are_as_good_as_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(docs, 100).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    learned = spark.createDataFrame([(i, "der hund" if i % 50 else "le chien", "de" if i % 50 else "fr") for i in range(1000)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.annotate(learned.limit(3), langid.fit(learned, 50)).orderBy("doc_id").collect()] == ["fr", "de", "de"]
