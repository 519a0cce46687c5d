"""The ranking operator on small catalogues."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from sagebeam.operators import ranking, scoring

RECORD = "record_id string, catalog_pos int, category string, slug string, canonical_id string, response_policy_id string, photo_cap double, indicators array<string>, exclusions array<string>, stages array<string>"
CASE = "case_id string, stage string, ph string, ec string, watering string, symptoms array<string>"
POLICY = "policy_id string, canonical_ids array<string>, cap double, can_confirm string, required array<string>, ord int"
VIEWS = ("whole-plant", "close-up", "underside", "root-crown")


def record(name, indicators, pos=0, category="Environmental stress", cap=None, canonical=None, exclusions=(), stages=()):
    return (name, pos, category, name, canonical, None, cap, list(indicators), list(exclusions), list(stages))


def rank(spark, records, symptoms, views=VIEWS, policies=(("POL-DEFAULT", ["*"], 0.8, "provisional_only", [], 0),), slugs=(), **case):
    facts = {"stage": "", "ph": "", "ec": "", "watering": ""} | case
    cases = spark.createDataFrame([("c", facts["stage"], facts["ph"], facts["ec"], facts["watering"], list(symptoms))], CASE)
    media = spark.createDataFrame([("c", v) for v in views], "case_id string, slot string")
    out = ranking.rank_cases(spark.createDataFrame(records, RECORD), cases, media, spark.createDataFrame(list(policies), POLICY), spark.createDataFrame(list(slugs), "slug string, slug_policy string"))
    return {r["record_id"]: r for r in out.collect()}


def test_nothing_selected_nothing_ranked(spark):
    assert rank(spark, [record("a", ["x"])], [], views=()) == {}


def test_rare_signs_outweigh_common_ones(spark):
    records = [record(f"common{i}", ["g1", "g2", "g3"], i) for i in range(5)] + [record("rare", ["u1", "u2"], 9)]
    got = rank(spark, records, ["g1", "g2", "g3", "U1 ", "u2"])
    assert got["rare"]["rank"] == 0 and got["rare"]["score"] == 8.0 and len(got) == 4


def test_look_alikes_are_held_at_moderate_and_ask(spark):
    got = rank(spark, [record("a", ["p", "q", "r"], 0), record("b", ["s", "t", "u"], 1)], "pqrstu", policies=[("POL-DEFAULT", [], 0.95, "true", [], 0)])
    assert [got[k]["confidence"] for k in "ab"] == ["Moderate", "Moderate"]
    assert ranking.ASK_SEPARATE in got["a"]["missing"] and ranking.ASK_SEPARATE not in got["b"]["missing"]


def test_own_ceiling_lowers_and_tells(spark):
    got = rank(spark, [record("a", ["p", "q", "r"], cap=0.5)], "pqr")
    assert got["a"]["confidence"] == "Low" and ranking.ASK_POLICY in got["a"]["missing"]


def test_canonical_policy_asks_for_its_confirmation(spark):
    policies = [("POL-DEFAULT", [], 0.8, "true", [], 0), ("P1", ["CAN-1"], 0.5, "false", ["RT-PCR", "RT-qPCR"], 1)]
    got = rank(spark, [record("a", ["p", "q", "r"], category="Viroid", canonical="CAN-1")], "pqr", policies=policies)
    assert got["a"]["confidence"] == "Low" and {"confirmation: RT-PCR", "confirmation: RT-qPCR", ranking.ASK_LAB} <= set(got["a"]["missing"])


def test_high_needs_signs_views_margin_and_ceiling(spark):
    got = rank(spark, [record("a", ["p", "q", "r"], cap=0.9)], "pqr")
    assert got["a"]["confidence"] == "High" and got["a"]["score"] == 12.0
    assert rank(spark, [record("a", ["p", "q", "r"], cap=0.9)], "pqr", views=("close-up",))["a"]["confidence"] == "Moderate"


def test_contradictions_and_bonuses(spark):
    records = [record("a", ["p", "q"], 0, exclusions=["z"], stages=["bloom"]), record("b", [], 1, category="Mite")]
    got = rank(spark, records, ["p", "q", "z"], stage="bloom")
    assert got["a"]["score"] == 4 + 4 - 5 + 1 and got["a"]["contradicting"] == ["z"]
    assert got["b"]["score"] == 1.0 and got["b"]["supporting"] == []


def test_signs_in_common_count_by_their_rarity_for_many_cases(spark, monkeypatch):
    """All pairs by hand: signed weights, repeated signs, bonuses, ties by place; several blocks and tiles give the same."""
    rng = random.Random(4)
    signs = [f"s{i}" for i in range(25)]
    some = lambda n: [rng.choice(signs) for _ in range(rng.randrange(n))]
    kinds = ("Mite", "Root pathogen", "Virus", "Environmental stress")
    records = [record(f"r{i}", some(9), 100 - i, category=rng.choice(kinds), exclusions=some(4), stages=rng.sample(["bloom", "seedling"], rng.randrange(3))) for i in range(60)]
    cases = [(f"c{i}", rng.choice(["", "bloom"]), "", "", "", some(8)) for i in range(15)]
    media = [(c[0], v) for c in cases for v in rng.sample(VIEWS, rng.randrange(4))]
    frequency = Counter(s for r in records for s in set(r[7]))
    tier = lambda s: next((w for most, w in ranking.TIERS if frequency[s] <= most), ranking.LEAST)
    want = {}
    for name, stage, *_, symptoms in cases:
        chosen, views, scored = set(symptoms), {v for c, v in media if c == name}, []
        for r in records:
            good, bad = [s for s in r[7] if s in chosen], [s for s in r[8] if s in chosen]
            score = sum(map(tier, good)) - sum(max(4.0, tier(s) + 1) for s in bad) + (stage != "" and stage in r[9])
            score += ("root-crown" in views and r[2] in ranking.ROOT) + ("underside" in views and r[2] in ranking.ARTHROPOD)
            if score > 0:
                scored.append((-score, r[1], r[0], good, bad))
        for place, (score, _, rec, good, bad) in enumerate(sorted(scored)[:4]):
            want[name, place] = (rec, -score, good, bad)
    frames = (spark.createDataFrame(records, RECORD).repartition(3), spark.createDataFrame(cases, CASE), spark.createDataFrame(media, "case_id string, slot string"))
    policies = (spark.createDataFrame([("POL-DEFAULT", ["*"], 0.8, "true", [], 0)], POLICY), spark.createDataFrame([], "slug string, slug_policy string"))
    got = lambda: {(r["case_id"], r["rank"]): (r["record_id"], r["score"], r["supporting"], r["contradicting"]) for r in ranking.rank_cases(*frames, *policies).collect()}
    assert got() == want
    monkeypatch.setattr(scoring, "WEIGHTS", 60)
    monkeypatch.setattr(scoring, "CELLS", 100)
    assert got() == want


@pytest.mark.parametrize(("frequency", "weight"), [(1, 4.0), (2, 3.5), (4, 3.0), (8, 2.5), (9, 2.0)])
def test_weights(spark, frequency, weight):
    from pyspark.sql import functions as F

    assert spark.range(1).select(ranking.weight(F.lit(frequency))).first()[0] == weight
