"""Small tables that the operator tests share."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "one two", "en", None, 7), (4, "one two", "en", None, 7), (None, "one two three four five six", "en", "a", 27),
    (7, "%%% ### 123", "en", "b", 11), (8, "ONE two Three four five six seven " * 3000, "en", "b", 102_000), (9, "İstanbul ölçü 日本語 emoji 😀 Straße", "de", "b", 34)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    frame = spark.createDataFrame(ODD, DOCS)
    from pyspark.sql import functions as F

    for name in ("score", "node", "bands", "size", "key", "lang_pred", "toxic_score", "taken", "spans", "n_words", "phrases", "held_out", "text_key", "x"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame.cache()
