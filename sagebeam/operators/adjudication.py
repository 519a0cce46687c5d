"""Adjudication of scored candidates against policies and an evidence index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALTERNATIVES = 3
DEFAULT_CEILING = 0.8
#: Open-set scores from here on make a result provisional; so do unresolved checks. Both hold the confidence below this ceiling.
UNKNOWN_FROM, HELD_CEILING = 0.55, 0.59


def ranked_candidates(candidates: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """``candidates`` with ``place`` from 0 within ``key``, best score first; only the leader and its alternatives."""
    by = Window.partitionBy(key).orderBy(F.desc(score), F.asc(tie))
    return candidates.withColumn("place", F.row_number().over(by)).where(F.col("place") <= ALTERNATIVES + 1).withColumn("place", F.col("place") - 1)


def final_confidence(top: Column, ceiling: Column, doubtful: Column) -> Column:
    capped = F.least(top, F.coalesce(ceiling, F.lit(DEFAULT_CEILING)))
    return F.when(doubtful, F.least(capped, F.lit(HELD_CEILING))).otherwise(capped)


def adjudicate(cases: DataFrame, policies: DataFrame, evidence: DataFrame, default: str = "POL-DEFAULT") -> DataFrame:
    """One row per case: primary, alternatives, final_confidence, provisional, response_policy_id, requested_evidence, controlled_evidence.

    ``cases``: case_id, candidates (canonical_id, canonical_label, calibrated_score,
    reasons), checks (unresolved, missing_evidence, contradictions),
    open_set_unknown_score, pass2_evidence_ids.  ``policies``: policy_id,
    canonical_ids, cap, can_confirm, ord.  ``evidence``: canonical_id, evidence.
    A case without candidates, or whose leader has no evidence, stops the job.
    """
    whole = F.struct("policy_id", "cap", "can_confirm")
    by_canonical = policies.select(F.explode("canonical_ids").alias("canonical_id"), "ord", whole.alias("p")).groupBy("canonical_id").agg(F.min_by("p", "ord").alias("p"))
    fallback = policies.where(F.col("policy_id") == default).select(F.col("policy_id").alias("d_id"), F.col("cap").alias("d_cap"), F.col("can_confirm").alias("d_confirm")).limit(1)
    placed = F.array_sort(
        F.transform("candidates", lambda c, i: F.struct((-c["calibrated_score"]).alias("by"), i.alias("at"), c.alias("c"))))  # equal scores keep their order
    asked = F.when(F.size("candidates") == 0, F.raise_error(F.lit("a case has no candidates")).cast("int"))
    out = cases.withColumn("placed", F.when(asked.isNull(), placed))
    out = out.withColumn("primary", F.col("placed")[0]["c"]).withColumn("canonical_id", F.col("primary.canonical_id"))
    out = out.join(by_canonical, "canonical_id", "left").join(evidence, "canonical_id", "left").withColumn("_one", F.lit(default)).join(fallback, F.col("_one") == F.col("d_id"), "left")
    grounded = F.when(F.coalesce(F.size("evidence"), F.lit(0)) < 1, F.raise_error(F.concat(F.lit("no controlled evidence for "), F.col("canonical_id"))).cast("int"))
    out = out.withColumn("evidence", F.when(grounded.isNull(), F.col("evidence")))
    policy = lambda name, other: F.when(F.col("p").isNotNull(), F.col(f"p.{name}")).otherwise(F.col(other))
    unresolved = F.exists("checks", lambda c: F.coalesce(c["unresolved"], F.lit(False)) | (F.coalesce(F.size(c["contradictions"]), F.lit(0)) > 0))
    doubtful = unresolved | (F.col("open_set_unknown_score") >= UNKNOWN_FROM)
    missing = F.array_distinct(F.flatten(F.transform("checks", lambda c: F.coalesce(c["missing_evidence"], F.expr("cast(array() as array<string>)")))))
    return out.select(
        "case_id", "primary", F.slice(F.transform("placed", lambda x: x["c"]), 2, ALTERNATIVES).alias("alternatives"),
        final_confidence(F.col("primary.calibrated_score"), policy("cap", "d_cap"), doubtful).alias("final_confidence"),
        (doubtful | F.coalesce(policy("can_confirm", "d_confirm") == "false", F.lit(False))).alias("provisional"),
        F.coalesce(policy("policy_id", "d_id"), F.lit(default)).alias("response_policy_id"), missing.alias("requested_evidence"), F.col("evidence").alias("controlled_evidence"), "pass2_evidence_ids")


def evidence_score(specific: Column, confirmation: Column, reuse: Column) -> Column:
    """Rank of a controlled record: host-specific, then how it was confirmed, less one if it is for reference only."""
    level = F.lower(F.coalesce(confirmation, F.lit("")))
    strong = level.contains("gold") | level.contains("molecular") | level.contains("causal")
    return (
        F.when(F.coalesce(specific, F.lit(False)), 20).otherwise(0) + F.when(strong, 20).when(level.contains("high"), 12).otherwise(0)
        - F.when(F.lower(F.coalesce(reuse, F.lit(""))).contains("reference_only"), 1).otherwise(0))
