"""License scans: an exact set-similarity join of text blocks with license templates, with DataFrame functions only.

For a template of L words, a block is a run of ``2 * L`` words, a new one
beginning every L words, so that any stretch of up to L words lies whole in a
block; the last blocks of a text are shorter.  A template T matches a block that
holds at least ``CONTAINMENT`` of its distinct words, that is need = ceil(c|T|).
Only words of templates can be in an overlap, so these alone get a global order,
rarest first, by the number of texts that hold them.  A text whose distinct words
share fewer than ``need`` with every template holds no match and leaves early.
In the others, a block is looked at only if it holds one of the first
|T| - need + 1 words of T in that order (prefix filter), has at least ``need``
template words (length filter), and if enough words of both follow the first
shared one (positional filter); then the overlap is counted.

Licenses share most of their wording, so words alone would take one for another
("released under the bsd license" holds four of the five words of the MIT notice).
A template therefore has phrases that tell it from others, and a block that meets
the threshold counts only if it holds these too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagebeam.llm.frames import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CONTAINMENT = 0.8

# Phrases whose words stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wording of public license notices, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "released under the mit license",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-2-notice": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or any later version",
    "gpl-3-notice": "this work is licensed under the gnu general public license version 3",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nc-sa": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "all-rights-reserved": "all rights reserved no part of this publication may be reproduced without prior written permission",
}

# The phrases of these notices that other licenses' wording does not have.
TELLING = {
    "mit": ("permission is hereby granted free of charge",),
    "mit-notice": ("mit license",),
    "apache-2": ("apache license version 2",),
    "apache-2-notice": ("apache license version 2",),
    "bsd": ("redistribution and use in source and binary forms",),
    "gpl-3": ("gnu general public license", "either version 3"),
    "gpl-3-notice": ("gnu general public license version 3",),
    "mpl-2": ("mozilla public license",),
    "cc-by-nc-notice": ("cc by nc",),
    "cc-by-nc": ("attribution noncommercial",),
    "cc-by-nc-sa": ("attribution noncommercial sharealike",),
    "cc-by-sa": ("attribution sharealike",),
    "cc-by-sa-notice": ("cc by sa",),
    "all-rights-reserved": ("all rights reserved",),
}


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z lowered."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _need(n: int, containment: float) -> int:
    return max(1, math.ceil(n * containment - 1e-9))


def _best(ranks: Column, order: list[int], span: int, telling: list[list[int]], containment: float) -> Column:
    """The largest containment, from the threshold up, of a template in a block of ``ranks`` (the order's
    numbers of a text's words, -1 for other words) that holds the phrases ``telling``; else 0.  ``order`` has
    the template's numbers, ascending."""
    need = _need(len(order), containment)
    prefix, whole = _array(order[: len(order) - need + 1]), _array(order)
    places = F.filter(F.sequence(F.lit(0), F.size(ranks) - 1), lambda i: F.array_contains(prefix, F.get(ranks, i)))
    blocks = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(F.floor(i / span).cast("int"), F.greatest(F.floor(i / span).cast("int") - 1, F.lit(0))))))

    def told(run: Column) -> Column:
        line = F.concat(F.lit(" "), F.array_join(run.cast("array<string>"), " "), F.lit(" "))
        out = F.lit(True)
        for phrase in telling:
            out = out & F.contains(line, F.lit(f" {' '.join(map(str, phrase))} "))
        return out

    def overlap(b: Column) -> Column:
        run = F.slice(ranks, b * span + 1, F.lit(2 * span))
        block = F.array_sort(F.array_distinct(F.filter(run, lambda r: r >= 0)))
        return F.when(told(run), count(block)).otherwise(0) if telling else count(block)

    def count(block: Column) -> Column:
        shared = F.array_intersect(whole, block)  # in the template's order, rarest first
        bound = 1 + F.least(len(order) - F.array_position(whole, shared[0]), F.size(block) - F.array_position(block, shared[0]))
        return F.when((F.size(block) >= need) & (bound >= need) & (F.size(shared) >= need), F.size(shared)).otherwise(0)

    return F.coalesce(F.array_max(F.transform(blocks, overlap)), F.lit(0)) / F.lit(float(len(order)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT, telling: dict[str, tuple[str, ...]] = TELLING) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with the license phrases and templates that its text holds.

    doc_id, n_words, n_base (places where a phrase's words stand consecutively),
    first_word and last_word (the smallest and largest of these places, words
    from 0, else null), base_labels, labels (those and the matching templates';
    both distinct, sorted, comma-joined) and score: the largest containment of a
    template in a block that met the threshold, 1 where there is a base phrase,
    else 0.  A template that ``telling`` has phrases for (of its own words) matches
    only blocks that hold them all.  The labels of two templates may be one: what follows the last
    "-notice" is cut.

    Null, empty and word-free texts have n_words 0, no places, empty labels and
    score 0.  Whole texts are scanned whatever their length.  Rows are judged one
    by one, so repeated rows and null ids need no care, and only the two columns
    are read.  A template of no words is left out.
    """
    sets = {k: list(dict.fromkeys(v.split())) for k, v in templates.items() if v.split()}
    vocabulary = sorted({w for s in sets.values() for w in s})
    rows = docs.select("doc_id", words(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "w", F.array_intersect(_array(vocabulary), "w").alias("seen"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("line"))
    held = F.lit(False)
    for k, s in sets.items():
        own = F.size(F.array_intersect("seen", _array(s))) >= _need(len(s), containment)
        for p in telling.get(k, ()):
            own = own & F.contains("line", F.lit(f" {p} "))
        held = held | own
    places = F.array_sort(F.concat(*[_places(p) for p in phrases]))
    named = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains("line", F.lit(f" {p} ")), F.lit(v)) for p, v in phrases.items()]))))
    first, _ = stored(rows.select("doc_id", F.size("w").cast("long").alias("n_words"), places.alias("places"), named.alias("named"), "seen", F.when(held, F.col("w")).alias("w")), "licenses-first")
    # At most a row per template word comes back.
    texts = {r["word"]: r["n"] for r in first.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (texts.get(w, 0), w))
    number = {w: i for i, w in enumerate(order)}
    ranked = first.withColumn("ranks", F.transform("w", lambda w: F.array_position(_array(order), w).cast("int") - 1))
    best = F.when(F.col("w").isNotNull(), F.array(*[_best(F.col("ranks"), sorted(number[w] for w in s), len(templates[k].split()), [[number[w] for w in p.split()] for p in telling.get(k, ())], containment) for k, s in sets.items()]))
    scored = ranked.withColumn("best", best)
    labels = [k.removesuffix("-notice") for k in sets]
    own = F.filter(F.transform(F.coalesce("best", F.array(F.lit(0.0))), lambda x, i: F.when(x > 0, F.get(_array(labels), i))), lambda x: x.isNotNull())
    n = F.size("places").cast("long")
    return scored.select(
        "doc_id", "n_words", n.alias("n_base"), F.get("places", F.lit(0)).cast("long").alias("first_word"), F.when(n > 0, F.element_at("places", -1)).cast("long").alias("last_word"),
        F.array_join("named", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("named", own)), ",").alias("labels"),
        F.when(n > 0, 1.0).otherwise(F.coalesce(F.array_max("best"), F.lit(0.0))).alias("score"))


def _places(phrase: str) -> Column:
    """Word numbers at which ``phrase`` begins in the array ``w``; only texts that hold it are searched."""
    parts = phrase.split()
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - len(parts)), lambda i: F.slice("w", i + 1, F.lit(len(parts))) == _array(parts))
    return F.when(F.contains("line", F.lit(f" {phrase} ")), starts).otherwise(F.expr("cast(array() as array<int>)"))
