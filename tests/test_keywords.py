"""Keyword groups by the automaton against plain substring search."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from sagebeam.functions.keywords import Automaton, groups_in
from sagebeam.operators import routing


def test_groups_of_texts_by_substring_search():
    rng = random.Random(1)
    for _ in range(60):
        groups = [["".join(rng.choice("abé") for _ in range(rng.randrange(0 if rng.random() < 0.1 else 1, 6))) for _ in range(rng.randrange(4))] for _ in range(rng.randrange(1, 6))]
        texts = ["".join(rng.choice("abcé ") for _ in range(rng.choice([0, 1, 5, 40, 700]))) for _ in range(8)]
        assert Automaton(groups)(pa.array(texts)).to_pylist() == [[g for g, terms in enumerate(groups) if any(t in x for t in terms)] for x in texts]


def test_keywords_across_the_edges_of_pieces():
    word, pad = "needle" * 30, 1000
    machine = Automaton([[word], ["absent"]])
    texts = ["x" * i + word + "y" * (pad - i) for i in range(0, pad, 37)]
    assert machine(pa.array(texts).slice(3)).to_pylist() == [[0]] * (len(texts) - 3)
    assert machine(pa.array([], pa.string())).to_pylist() == []


def test_column_of_groups(spark):
    rows = spark.createDataFrame([(1, "a mite on hemp"), (2, None), (3, "")], "id int, t string")
    assert [r[1] for r in rows.select("id", groups_in(F.col("t"), [("hemp",), ("mite", "aphid"), ()])).orderBy("id").collect()] == [[0, 1], [], []]


def test_lanes_by_the_automaton_are_those_by_columns(spark):
    rng = random.Random(2)
    words = [t for terms in routing.LANES.values() for t in terms] + ["leaf", "stem", "hemp", "cannabis"] * 8
    rows = [(i, " ".join(rng.sample(words, rng.randrange(5))), rng.choice(["", "Cross-Crop x", "organism-only", "field"]), rng.choice(["", None, "tomato"])) for i in range(300)]
    frame = spark.createDataFrame(rows, "id int, blob string, host_context string, host_species string")
    by_column = frame.withColumn("want", routing.lane(F.col("blob"), F.col("host_context"), F.col("host_species")))
    assert routing.routed(by_column, "blob", "host_context", "host_species").where("lane <> want").count() == 0
