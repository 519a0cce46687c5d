"""The corpus pipeline: language, toxicity, near duplicates, benchmark passages, and the mix of sources.

Each stage is a function of (spark, docs, sf_dir) over what the one before kept;
``run`` writes every stage's rows as Parquet in the shared folder and reads them
again for the next.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebeam.llm import decontaminate, langid, minhash, mixing, toxicity
from sagebeam.llm.frames import spread, stored, table

#: Percent of the union of two documents' shingles at which they count as near duplicates.
NEAR = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told go on, however short or mixed; texts without letters, null and empty ones among them, do not.

    Repeated rows go on or out together.  Without any labelled row no language can be told, and none goes on.
    """
    return langid.keep_identified(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the toxicity threshold go on, repeated ones alike.

    Null and empty texts have the score of an empty text.  With no labels, or only one, every row goes on.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates goes on, that of the smallest doc_id; texts without words have no group and go on.

    Of rows that share that id, the one whose text has the smallest hash goes on, and of equal rows one.
    """
    return minhash.keep_one(docs, NEAR)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any benchmark phrase go on, null and empty texts among them; an empty benchmark lets all go on."""
    found, (n_words, spans, phrases) = decontaminate.annotate(docs, decontaminate.phrase_table(table(spark, sf_dir, "benchmark")))
    return found.where(F.size(spans) == 0).drop(n_words, spans, phrases)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, with the words taken, repeats counted.  Texts without words give nothing; a null source is one of its own."""
    return mixing.mixed(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix)]

#: Two of the stages are trained models, which SQL cannot express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
