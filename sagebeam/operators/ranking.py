"""Rarity-weighted evidence ranking of catalogue records, for many cases in one job.

Records bear signs for and against them, stages and categories as marks; ``scoring``
finds the best of each case by signed weights without a row for a pair.  Only the
records kept are then joined with their case for the lists of signs, the gates and
the policies.  Frequencies are counted over the catalogue.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagebeam.functions import text as T
from sagebeam.operators.scoring import best_records

# Categories and slugs that the evidence gates name.
LABORATORY = ("Bacterial pathogen", "Viroid", "Virus", "Phytoplasma / Spiroplasma")
ROOT = ("Root pathogen", "Water / root-zone")
ARTHROPOD = ("Mite", "Insect")
NUTRIENT = ("Nutrient deficiency", "Nutrient toxicity")
WATERING = ("Water / root-zone", "Root pathogen", "Environmental stress")
MICROSCOPIC = ("hemp-russet-mite", "broad-mite")
SLOTS = ("whole-plant", "close-up", "underside", "root-crown")

# What a ranked record may still ask for.
ASK_WHOLE, ASK_CLOSE, ASK_UNDER, ASK_ROOT = "whole-plant view", "affected-tissue close-up", "leaf-underside image", "root or crown view"
ASK_LAB, ASK_MICROSCOPE = "validated laboratory test", "microscope-confirmed mite identification"
ASK_PH, ASK_EC, ASK_WATER = "measured pH", "measured EC/PPM", "recent irrigation / substrate-moisture context"
ASK_POLICY, ASK_NON_VISUAL = "response policy limits photo-only confidence", "non-visual confirmation required by issue confidence policy"
ASK_SEPARATE = "additional discriminating evidence between the leading look-alikes"

TOP = 4

# What a sign counts, by the most records that have it; more common ones count least.
TIERS, LEAST = ((1, 4.0), (2, 3.5), (4, 3.0), (8, 2.5)), 2.0
# Fixed value: a contradiction takes away one more than the sign would give, and at least this.
LEAST_PENALTY = 4.0
#: Kinds of weighed marks.
SUPPORT, CONTRADICTION, BONUS = 1, -1, 0


def frequencies(indicators: DataFrame) -> DataFrame:
    """(key, frequency) of ``indicators(record_id, key)``: records that have the sign, each once."""
    return indicators.select("record_id", "key").distinct().groupBy("key").agg(F.count("*").alias("frequency"))


def weight(frequency: Column) -> Column:
    """What a sign counts: the rarer, the more."""
    out = F.lit(LEAST)
    for most, counts in reversed(TIERS):
        out = F.when(frequency <= most, counts).otherwise(out)
    return out


def penalty(frequency: Column) -> Column:
    """What a contradiction takes away."""
    return F.greatest(F.lit(LEAST_PENALTY), weight(frequency) + 1)


def weigh(kind: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Signed weights of marks of each kind; a sign that no record lists counts as one that a single record has."""
    w = np.array([counts for _, counts in TIERS] + [LEAST])[np.searchsorted([most for most, _ in TIERS], frequency)]
    return np.where(kind == SUPPORT, w, np.where(kind == CONTRADICTION, -np.maximum(LEAST_PENALTY, w + 1), 1.0))


def support(indicators: DataFrame, symptoms: DataFrame) -> DataFrame:
    """(case_id, record_id, supporting, n_matched) from ``indicators(record_id, key)`` and ``symptoms(case_id, key)``.

    A sign that a record lists twice counts twice; its frequency counts it once.
    """
    wanted = symptoms.select("key").distinct()
    own = indicators.join(wanted, "key", "left_semi")
    weighed = own.join(frequencies(own), "key").select("record_id", "key", weight(F.col("frequency")).alias("w"))
    return weighed.join(symptoms.select("case_id", "key").distinct(), "key").groupBy("case_id", "record_id").agg(F.sum("w").alias("supporting"), F.count("*").alias("n_matched"))


def top_support(listed: DataFrame, symptoms: DataFrame, k: int = TOP) -> DataFrame:
    """(case_id, record_id, score, n_matched): the best k records of each case by ``support``, and more, ties by record_id.

    ``listed`` has (record_id long, keys: array of signs), ``symptoms`` (case_id, key).
    """
    wanted = symptoms.where("key is not null").select("case_id", F.col("key").alias("mark"), F.col("key").alias("counted"), F.lit(SUPPORT).alias("kind")).distinct()
    best = best_records(listed.select("record_id", F.col("record_id").alias("pos"), F.col("keys").alias("marks")), wanted, weigh, k)
    # Only the records kept are looked at again.
    keys = symptoms.groupBy("case_id").agg(F.collect_set("key").alias("own"))
    kept = top_per_case(best, "pos", k).join(keys, "case_id").join(listed.select("record_id", "keys"), "record_id")
    return kept.select("case_id", "record_id", "score", F.size(F.filter("keys", lambda x: F.array_contains("own", x))).cast("long").alias("n_matched"))


def contradiction(exclusions: DataFrame, indicators: DataFrame, symptoms: DataFrame) -> DataFrame:
    """(case_id, record_id, contradicting, n_contradicted); signs that no record lists as an indicator have frequency 1."""
    wanted = symptoms.select("key").distinct()
    known = frequencies(indicators.join(wanted, "key", "left_semi"))
    weighed = exclusions.join(wanted, "key", "left_semi").join(known, "key", "left").select("record_id", "key", penalty(F.coalesce("frequency", F.lit(1))).alias("w"))
    return weighed.join(symptoms.select("case_id", "key").distinct(), "key").groupBy("case_id", "record_id").agg(F.sum("w").alias("contradicting"), F.count("*").alias("n_contradicted"))


def top_per_case(scored: DataFrame, order: str, k: int = TOP) -> DataFrame:
    """The k best rows with a positive score of each case, ``rank`` from 0, ties by ``order``; ``next_score`` is that of the row below."""
    by = Window.partitionBy("case_id").orderBy(F.desc("score"), F.asc(order))
    # Compared as it is, the row number limits each group before the shuffle as well.
    kept = scored.where("score > 0").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
    return kept.withColumn("next_score", F.lead("score").over(Window.partitionBy("case_id").orderBy("rank")))


def resolve_policy(records: DataFrame, policies: DataFrame, slug_policies: DataFrame, default: str = "POL-DEFAULT") -> DataFrame:
    """``records`` with cap_policy, can_confirm, required and resolved_policy_id.

    Asked in turn: the record's own policy id, the first policy (by ``ord``) that
    lists its canonical id, the policy of its slug, the default.  ``policies``:
    policy_id, canonical_ids, cap, can_confirm, required, ord; ``slug_policies``:
    slug, slug_policy.
    """
    whole = F.struct("policy_id", "cap", "can_confirm", "required")
    by_id = policies.groupBy("policy_id").agg(F.min_by(whole, "ord").alias("p"))
    by_canonical = policies.select(F.explode("canonical_ids").alias("canonical_id"), "ord", whole.alias("q")).groupBy("canonical_id").agg(F.min_by("q", "ord").alias("by_canonical"))
    out = records.join(by_id.select(F.col("policy_id").alias("response_policy_id"), F.col("p").alias("by_id")), "response_policy_id", "left")
    out = out.join(by_canonical, "canonical_id", "left").join(slug_policies, "slug", "left")
    out = out.join(by_id.select(F.col("policy_id").alias("slug_policy"), F.col("p").alias("by_slug")), "slug_policy", "left")
    out = out.withColumn("_default", F.lit(default)).join(by_id.select(F.col("policy_id").alias("_default"), F.col("p").alias("by_default")), "_default", "left")
    p = F.coalesce("by_id", "by_canonical", "by_slug", "by_default")
    return out.withColumn("_p", p).select(
        *records.columns, F.col("_p.policy_id").alias("resolved_policy_id"), F.col("_p.cap").alias("cap_policy"), F.col("_p.can_confirm").alias("can_confirm"), F.col("_p.required").alias("required"))


def gated_band(score: Column, n_matched: Column, n_contradicted: Column, category: Column, slug: Column, has: dict[str, Column], ph: Column, ec: Column) -> Column:
    """The band (0 to 2) that signs and views allow, before any policy."""
    out = F.when((score >= 10) & (n_matched >= 3) & (n_contradicted == 0), 2).when((score >= 5) & (n_matched >= 2), 1).otherwise(0)
    most = lambda held, top: F.least(out, F.when(held, top).otherwise(2))
    out = most(category.isin(*LABORATORY), 0)
    out = most((category == "Root pathogen") & ~has["root-crown"], 0)
    out = most((category == "Mite") & ~has["underside"], 0)
    out = most((category == "Mite") & slug.isin(*MICROSCOPIC), 1)
    out = most((category == "Insect") & ~has["underside"], 1)
    out = most(category.isin(*NUTRIENT) & ((ph == "") | (ec == "")), 1)
    return most(~has["whole-plant"] | ~has["close-up"], 1)


def asked(category: Column, slug: Column, has: dict[str, Column], ph: Column, ec: Column, watering: Column) -> Column:
    """What is still missing, in a fixed order."""
    chemistry = category.isin(*NUTRIENT, *ROOT)
    rules = (
        (~has["whole-plant"], ASK_WHOLE), (~has["close-up"], ASK_CLOSE), (category.isin(*ARTHROPOD) & ~has["underside"], ASK_UNDER), (category.isin(*ROOT) & ~has["root-crown"], ASK_ROOT),
        (category.isin(*LABORATORY), ASK_LAB), (slug.isin(*MICROSCOPIC), ASK_MICROSCOPE), (chemistry & (ph == ""), ASK_PH), (chemistry & (ec == ""), ASK_EC), (category.isin(*WATERING) & (watering == ""), ASK_WATER))
    return F.array_compact(F.array(*[F.when(rule, F.lit(label)) for rule, label in rules]))


def with_policy(level: Column, missing: Column, own_cap: Column, policy_cap: Column, can_confirm: Column, required: Column) -> tuple[Column, Column]:
    """Band and list after the photo-only ceiling; without a finite ceiling both stay."""
    ceiling = T.cap(F.coalesce(own_cap, policy_cap))
    capped = F.least(level, T.band(ceiling))
    need = F.coalesce(required, F.expr("cast(array() as array<string>)"))
    labels = F.when(F.size(need) == 0, F.array(F.lit(ASK_NON_VISUAL))).otherwise(F.transform(need, lambda r: F.concat(F.lit("confirmation: "), r)))
    more = F.concat(F.when(capped != level, F.array(F.lit(ASK_POLICY))).otherwise(F.expr("cast(array() as array<string>)")), F.when(can_confirm == "false", labels).otherwise(F.expr("cast(array() as array<string>)")))
    return F.when(ceiling.isNull(), level).otherwise(capped), F.when(ceiling.isNull(), missing).otherwise(F.array_union(missing, more))


def rank_cases(records: DataFrame, cases: DataFrame, media: DataFrame, policies: DataFrame, slug_policies: DataFrame, k: int = TOP) -> DataFrame:
    """At most k records per case: case_id, rank, record_id, score, confidence, supporting, contradicting, missing.

    ``records``: record_id, catalog_pos, category, slug, canonical_id,
    response_policy_id, photo_cap, indicators, exclusions, stages; ``cases``:
    case_id, stage, ph, ec, watering (empty: not given), symptoms; ``media``:
    case_id, slot.  Ties keep the catalogue's order.  A case without any match is
    not in the result.
    """
    keys = lambda column: F.transform(F.coalesce(F.col(column), F.expr("cast(array() as array<string>)")), T.normalise)
    tagged = lambda tag, values: F.transform(values, lambda x: F.concat(F.lit(tag), x))
    marks = F.concat(
        tagged("+", keys("indicators")), tagged("-", keys("exclusions")),
        tagged("s", F.array_distinct(F.coalesce("stages", F.expr("cast(array() as array<string>)")))), F.array(F.concat(F.lit("c"), "category")))
    symptoms = cases.select("case_id", F.explode("symptoms").alias("sign")).select("case_id", T.normalise(F.col("sign")).alias("key")).where("key is not null").distinct()
    slots = media.groupBy("case_id").agg(*[F.bool_or(F.col("slot") == s).alias(s) for s in SLOTS])
    asks = lambda rows, mark, counted, kind: rows.select("case_id", mark.alias("mark"), counted.alias("counted"), F.lit(kind).alias("kind"))
    own = F.concat(F.lit("+"), "key")
    wanted = asks(symptoms, own, own, SUPPORT).unionByName(asks(symptoms, F.concat(F.lit("-"), "key"), own, CONTRADICTION))
    staged = F.concat(F.lit("s"), "stage")
    wanted = wanted.unionByName(asks(cases.where("stage <> ''"), staged, staged, BONUS))
    for slot, names in (("root-crown", ROOT), ("underside", ARTHROPOD)):
        seen = cases.select("case_id").join(slots.where(F.col(f"`{slot}`")).select("case_id"), "case_id").select("case_id", F.explode(F.array(*[F.lit(f"c{c}") for c in names])).alias("mark"))
        wanted = wanted.unionByName(asks(seen, F.col("mark"), F.col("mark"), BONUS))
    found = best_records(records.select("record_id", F.col("catalog_pos").cast("long").alias("pos"), marks.alias("marks")), wanted, weigh, k)
    best = top_per_case(found, "pos", k).drop("pos")
    # Lists are made of the records kept alone.
    of = lambda column: F.filter(column, lambda sign: F.array_contains("selected", T.normalise(sign))).alias(f"of_{column}")
    selected = symptoms.groupBy("case_id").agg(F.collect_set("key").alias("selected"))
    best = best.join(selected, "case_id", "left").withColumn("selected", F.coalesce("selected", F.expr("cast(array() as array<string>)")))
    best = best.join(records.select("record_id", "indicators", "exclusions"), "record_id")
    nothing = F.expr("cast(array() as array<string>)")
    best = best.select("case_id", "record_id", "rank", "score", "next_score", F.coalesce(of("indicators"), nothing).alias("supporting"), F.coalesce(of("exclusions"), nothing).alias("contradicting"))
    facts = resolve_policy(records.drop("indicators", "exclusions", "stages", "catalog_pos"), policies, slug_policies)
    out = best.join(facts, "record_id").join(cases.drop("symptoms"), "case_id").join(slots, "case_id", "left")
    has = {s: F.coalesce(F.col(f"`{s}`"), F.lit(False)) for s in SLOTS}
    level = gated_band(F.col("score"), F.size("supporting"), F.size("contradicting"), F.col("category"), F.col("slug"), has, F.col("ph"), F.col("ec"))
    missing = asked(F.col("category"), F.col("slug"), has, F.col("ph"), F.col("ec"), F.col("watering"))
    level, missing = with_policy(level, missing, F.col("photo_cap"), F.col("cap_policy"), F.col("can_confirm"), F.col("required"))
    level, missing = after_ranking(level, missing)
    return out.select("case_id", "rank", "record_id", "score", T.band_name(level).alias("confidence"), "supporting", "contradicting", missing.alias("missing"))


def after_ranking(level: Column, missing: Column) -> tuple[Column, Column]:
    """Only the leader may be high, and only with a margin of 2 over the next; else it asks for what separates them."""
    close = (F.col("rank") == 0) & F.col("next_score").isNotNull() & (F.col("score") - F.col("next_score") < 2)
    return F.when((F.col("rank") > 0) | close, F.least(level, F.lit(1))).otherwise(level), F.when(close, F.array_union(missing, F.array(F.lit(ASK_SEPARATE)))).otherwise(missing)
