"""Declarative data-quality rules whose results are rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagebeam.functions import text as T


@dataclass(frozen=True)
class Rule:
    """A row that does not meet ``holds`` violates the rule; a null outcome is a violation too."""

    name: str
    holds: Column


def violations(rows: DataFrame, dataset: str, key: str, rules: list[Rule]) -> DataFrame:
    """(dataset, row_key, rule) for every row and rule that fail, in one pass over the rows."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(r.holds, F.lit(False)), F.lit(r.name)) for r in rules]))
    return rows.select(F.lit(dataset).alias("dataset"), F.col(key).cast("string").alias("row_key"), F.explode(failed).alias("rule"))


def required(*fields: str) -> list[Rule]:
    """Each field is there and not blank."""
    return [Rule(f"{f} is required", F.coalesce(T.strip(F.col(f).cast("string")), F.lit("")) != "") for f in fields]


def pattern(field: str, regex: str) -> Rule:
    return Rule(f"{field} has the wrong form", F.regexp_like(F.col(field), F.lit(regex)))


def one_of(field: str, *values: str) -> Rule:
    return Rule(f"{field} is not allowed", F.col(field).isin(*values))


def is_url(field: str) -> Rule:
    return Rule(f"{field} is no URL", T.valid_url(F.col(field)))


def implies(name: str, condition: Column, consequence: Column) -> Rule:
    return Rule(name, ~F.coalesce(condition, F.lit(False)) | F.coalesce(consequence, F.lit(False)))


def at_least(field: str, n: int) -> Rule:
    return Rule(f"{field} has fewer than {n} entries", F.size(field) >= n)


def holds_all(field: Column, name: str, *terms: str) -> Rule:
    """A text with every one of the terms, whatever the case."""
    out = F.lit(True)
    for t in terms:
        out = out & F.contains(F.lower(field), F.lit(t.lower()))
    return Rule(name, out)


def repeated(rows: DataFrame, dataset: str, *fields: str) -> DataFrame:
    """(dataset, row_key, rule) once for each non-null value that stands more than once in a field that must be unique."""
    parts = [rows.where(F.col(f).isNotNull()).groupBy(F.col(f).cast("string").alias("row_key")).count().where("count > 1").select(F.lit(dataset).alias("dataset"), "row_key", F.lit(f"{f} is not unique").alias("rule")) for f in fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Parent keys that are broadcast at most, and rows that a task of a join with more sorts, about.
BROADCAST_KEYS, ROWS_A_TASK = 500_000, 1 << 19


def orphans(rows: DataFrame, dataset: str, key: str, field: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """(dataset, row_key, rule) for rows whose reference has no parent; null references are left alone.

    Few parents are broadcast; with more, both sides are dealt to so many tasks that what each holds is bounded.
    """
    spark = rows.sparkSession
    slim = rows.where(F.col(field).isNotNull()).select(F.col(key).cast("string").alias("row_key"), F.col(field).alias("_reference"))
    known = parents.where(F.col(parent_key).isNotNull()).select(F.col(parent_key).alias("_reference"))
    many = parents.count()
    if many <= BROADCAST_KEYS:
        known = F.broadcast(known.distinct())
    else:
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(many, rows.count()) // ROWS_A_TASK))
        slim, known = slim.repartition(n, "_reference"), known.repartition(n, "_reference").distinct()
    lost = slim.join(known, "_reference", "left_anti")
    return lost.select(F.lit(dataset).alias("dataset"), "row_key", F.lit(f"{field} has no parent").alias("rule"))


def reconcile(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(metric, actual, expected, agrees) from two tables of (metric, value); a metric of one side alone does not agree."""
    a, b = actual.select("metric", F.col("value").alias("actual")), expected.select("metric", F.col("value").alias("expected"))
    return a.join(b, "metric", "full").select("metric", "actual", "expected", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)).alias("agrees"))


def require_none(found: DataFrame) -> None:
    """Stop with the first violations if there are any."""
    some = found.limit(20).collect()
    if some:
        raise ValueError("; ".join(str(tuple(r)) for r in some))


# Ready-made rule sets of the snapshots; columns are named as in their files.  Fields that must be unique go to ``repeated``, record counts to ``reconcile``.
ACQUISITION_UNIQUE, SOURCE_UNIQUE, PERMISSION_UNIQUE = ("datasetId", "driveFolderId"), ("id",), ("requestId", "datasetId")
# The form of dataset ids, and the words that tell restricted rights.
_DATASET_ID = r"^DS-\d{3,}$"
_RESTRICTED = "noncommercial|non-commercial|sharealike|share-alike|rights verify|license verify|per-item|per-media|gate|required"


def acquisition_rules() -> list[Rule]:
    rights, lane, status, integrity = F.lower(F.concat_ws(" ", "license", "rightsStatus")), F.lower("destination"), F.lower("acquisitionStatus"), F.lower("integrityStatus")
    done = F.regexp_like(integrity, F.lit("verified|complete|passed|ready")) & ~integrity.contains("pending")
    return [
        *required("sheetRow", "order", "datasetId", "dataset", "canonicalSource", "version", "expectedPackage", "repositoryChecksum", "license", "destination", "acquisitionStatus", "integrityStatus", "rightsStatus", "criticalNotes", "driveFolderId"),
        pattern("datasetId", _DATASET_ID), is_url("canonicalSource"),
        implies("open lane with restricted rights", lane.startswith("01_raw_open"), ~F.regexp_like(rights, F.lit(_RESTRICTED))),
        implies("quarantined outside quarantine", status.contains("quarantine"), lane.contains("quarantine")),
        implies("blocked at run time but complete", status.contains("runtime") & status.contains("blocked"), ~F.coalesce(done, F.lit(False)))]


def source_rules() -> list[Rule]:
    rights = F.lower(F.concat_ws(" ", "license", "academicUse", "rawRedistribution", "publicModelDeployment"))
    return [
        *required("id", "name", "domain", "cannabisSpecific", "modality", "primaryTask", "license", "academicUse", "rawRedistribution", "publicModelDeployment", "priority", "sourceUrl", "provenanceStatus"),
        pattern("id", _DATASET_ID), one_of("cannabisSpecific", "YES", "NO", "PARTIAL"), one_of("priority", "P0", "P1", "P2", "P3"), is_url("sourceUrl"),
        implies("unknown rights need a look at provenance", rights.contains("unknown"), F.lower("provenanceStatus").contains("verify"))]


def permission_rules() -> list[Rule]:
    """``contact`` is a struct, the three lists of what is asked for are arrays, dates are strings."""
    return [
        *required("requestId", "datasetId", "source", "priority", "status", "contact", "requestedAssets", "requestedMetadata", "rightsRequested", "acquisitionRule", "notes"),
        pattern("requestId", r"^PERM-\d{3}$"), pattern("datasetId", _DATASET_ID), one_of("priority", "P0", "P1", "P2", "P3"),
        one_of("status", "REQUEST_DRAFT_READY", "READY_TO_SEND", "SENT", "RESPONSE_RECEIVED", "APPROVED", "PARTIAL_APPROVAL", "DECLINED", "CLOSED_NO_RESPONSE"),
        at_least("requestedAssets", 1), at_least("requestedMetadata", 1), at_least("rightsRequested", 1), *required("contact.nameOrOrganization"),
        implies("a draft has no request date", F.col("status") == "REQUEST_DRAFT_READY", F.coalesce("requestedDate", F.lit("")) == ""),
        implies("an approval has a response date", F.col("status") == "APPROVED", F.coalesce("responseDate", F.lit("")) != "")]


# The datasets of the transfer policy.
_TRANSFER_IDS = [f"DS-{n}" for n in range(137, 147)]


def transfer_rules() -> list[Rule]:
    """Of the transfer policy as one row: policyVersion, structs ``scope`` and ``invariants``, and the map ``datasetRules`` of structs with arrays role, rules and beneficialClasses."""
    fixed = {"cannabisCausalGroundTruth": False, "preserveOriginalSourceLabels": True, "requireCannabisSpecificConfirmationForCannabisEtiology": True, "requireSha256AndPerceptualDedupBeforeTraining": True, "allowIndependentSampleInflationFromDerivatives": False}

    def of(dataset: str, field: str) -> Column:
        return F.try_element_at("datasetRules", F.lit(dataset))[field]

    terms = {("DS-140", "rules"): ("overlap", "double-count"), ("DS-141", "rules"): ("64", "sourcegroupid", "one split"), ("DS-142", "rules"): ("white-background", "natural-background"),
             ("DS-146", "beneficialClasses"): ("lacewing", "hoverfly", "lady beetle"), ("DS-146", "rules"): ("hard negatives", "harmful-insect")}
    return [
        *required("policyVersion"), Rule("scope.datasetIds are others", F.col("scope.datasetIds") == F.array(*map(F.lit, _TRANSFER_IDS))),
        *[Rule(f"invariants.{k} is not {str(v).lower()}", F.col(f"invariants.{k}") == v) for k, v in fixed.items()], at_least("invariants.allowedUses", 4), at_least("invariants.forbiddenUses", 4),
        *[Rule(f"{d} {f} missing", F.size(of(d, f)) >= 1) for d in _TRANSFER_IDS for f in ("role", "rules")], Rule("DS-146 has fewer than 3 beneficialClasses", F.size(of("DS-146", "beneficialClasses")) >= 3),
        *[holds_all(F.array_join(of(d, f), " "), f"{d} {f} incomplete", *t) for (d, f), t in terms.items()]]


# Hosts and licenses that media may come from and under.
HOSTS = ("academic.oup.com", "oup.silverchair-cdn.com", "www.frontiersin.org", "frontiersin.org", "pmc.ncbi.nlm.nih.gov", "www.ncbi.nlm.nih.gov", "cdn.ncbi.nlm.nih.gov", "www.mdpi.com", "mdpi-res.com",
          "media.springernature.com", "bugwoodcloud.org", "content.ces.ncsu.edu", "commons.wikimedia.org", "www.preprints.org")
LICENSES = ("CC BY 4.0", "CC BY 3.0", "CC BY 3.0 US", "CC BY", "Public domain (US federal government work)")


def persistence_rules() -> list[Rule]:
    """Of media to be kept, with what was fetched: content_type and byte_size."""
    fields = ("id", "issue_slug", "image_url", "source_article", "caption", "creator", "license", "intended_use")
    return [
        *[Rule(f"{f} is required", F.coalesce(F.col(f).cast("string"), F.lit("")) != "") for f in fields], one_of("intended_use", "reference-only"), one_of("license", *LICENSES),
        Rule("image_url is not on an allowed host", (F.lower(F.try_parse_url("image_url", F.lit("PROTOCOL"))) == "https") & F.lower(F.try_parse_url("image_url", F.lit("HOST"))).isin(*HOSTS)),
        Rule("content_type is no image", F.col("content_type").startswith("image/")), Rule("byte_size is not from 1 to 20000000", F.col("byte_size").between(1, 20_000_000))]


# Fields and lists of a profile, and how many profiles there are at least.
PROFILE_FIELDS = ("id", "slug", "name", "category", "severity", "reviewStatus", "summary")
PROFILE_LISTS = ("affectedParts", "stages", "indicators", "exclusions", "progression", "lookAlikes", "confirmation", "immediateActions", "correctivePlan", "prevention", "warnings", "sources", "media")
LEAST_PROFILES = 61


def export_rules(fields: tuple[str, ...] = PROFILE_FIELDS, lists: tuple[str, ...] = PROFILE_LISTS) -> list[Rule]:
    """Of profiles that are to be exported: every field and list is there, and at least one source; empty texts pass here, not in a release."""
    return [*[Rule(f"{f} is missing", F.col(f).isNotNull()) for f in (*fields, *lists)], at_least("sources", 1)]


def release_rules(fields: tuple[str, ...] = PROFILE_FIELDS, lists: tuple[str, ...] = PROFILE_LISTS) -> list[Rule]:
    """Of released profiles: as ``export_rules``, and no field is empty."""
    return [*[Rule(f"{f} is missing", F.coalesce(F.col(f).cast("string"), F.lit("")) != "") for f in fields], *[Rule(f"{f} is missing", F.col(f).isNotNull()) for f in lists]]


def refuse_partial(rows: DataFrame, least: int = LEAST_PROFILES) -> DataFrame:
    """``rows``, stopping where there are fewer than ``least``; a single count joins every row."""
    counted = rows.agg(F.count("*").alias("_rows"))
    few = F.when(F.col("_rows") < least, F.raise_error(F.concat(F.lit(f"at least {least} rows are expected, there are "), F.col("_rows").cast("string"))).cast("boolean"))
    checked = counted.where(few.isNull()).drop("_rows").withColumn("_sound", F.lit(True))
    return checked.crossJoin(rows).drop("_sound")  # a row beside the rows


#: Metrics of a release, each by the manifests that repeat it.
RELEASE_METRICS = {
    "profiles": ("manifest.diagnosticProfileCount", "manifest.standaloneDetailedProfileCount", "modelReadiness.knowledgeLayer.diagnosticProfiles", "modelReadiness.knowledgeLayer.materializedProfiles", "splitManifest.knowledgeLayerSnapshot.diagnosticProfiles"),
    "sources": ("manifest.evidenceSourceCount", "modelReadiness.knowledgeLayer.evidenceSources", "splitManifest.knowledgeLayerSnapshot.evidenceSources"),
    "profileMedia": ("manifest.profileReferenceMediaCount", "modelReadiness.knowledgeLayer.profileLinkedReferenceMedia", "splitManifest.knowledgeLayerSnapshot.profileLinkedReferenceMedia"),
    "trainingEligible": ("manifest.trainingEligibleMediaCount", "modelReadiness.visionLayer.trainingEligibleSamples", "splitManifest.counts.totalTrainingEligible"),
    "originals": ("manifest.localReferenceImageBinaryCount", "modelReadiness.visionLayer.referenceOriginals", "splitManifest.knowledgeLayerSnapshot.referenceOriginals"),
    "crops": ("manifest.referencePanelCropCount", "modelReadiness.visionLayer.referenceCrops", "splitManifest.knowledgeLayerSnapshot.referenceCrops"),
    "totalReferenceImages": ("manifest.totalPersistedReferenceImageFiles", "modelReadiness.visionLayer.totalReferenceImages"),
}


def release_counts(actual: DataFrame, told: DataFrame) -> DataFrame:
    """(label, actual, told, agrees) for every place that repeats a metric: ``actual`` (metric, value), originals and crops adding up to all images, against ``told`` (label, value)."""
    pictures = actual.where(F.col("metric").isin("originals", "crops")).agg(F.sum("value").alias("value")).select(F.lit("totalReferenceImages").alias("metric"), "value")
    labels = actual.sparkSession.createDataFrame([(m, x) for m, xs in RELEASE_METRICS.items() for x in xs], "metric string, label string")
    both = labels.join(actual.select("metric", F.col("value").alias("actual")).unionByName(pictures.withColumnRenamed("value", "actual")), "metric", "left").join(told.select("label", F.col("value").alias("told")), "label", "left")
    return both.select("label", "actual", "told", F.coalesce(F.col("actual") == F.col("told"), F.lit(False)).alias("agrees"))


def split_gate(eligible: Column, ready: Column, model_ready: Column, *parts: Column) -> Column:
    """What is wrong with splits while nothing is eligible: they must be empty and not ready, and the model not ready either."""
    total = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
    none = eligible == 0
    return F.array_compact(F.array(
        F.when(none & ~model_ready.eqNullSafe(F.lit(False)), F.lit("model readiness must remain false")),
        F.when(none & (~ready.eqNullSafe(F.lit(False)) | (total != 0)), F.lit("splits must remain empty and blocked"))))


def media_rules() -> list[Rule]:
    """Hash forms, and what eligibility for training and the locked split imply."""
    return [pattern("sha256", "^[a-f0-9]{64}$"), pattern("perceptualHash", "^dhash64:[a-f0-9]{16}$"),
            implies("eligible without permission", F.col("trainingEligible"), F.col("trainingPermission") == "permitted"), implies("eligible without a split", F.col("trainingEligible"), F.coalesce(F.col("datasetSplit"), F.lit("none")) != "none"),
            implies("locked evaluation is not for training", F.col("datasetSplit") == "locked-evaluation", ~F.col("trainingEligible"))]


_PERMISSIONS = ("permitted", "not-permitted", "unknown")


def provenance_rules() -> list[Rule]:
    """Of a record's media (with the record's ``slug``): provenance, license, permissions, hashes of approved ones, and what hosts and permissions rule out."""
    approved, eligible = F.col("reviewStatus").isin("approved-reference", "approved-training"), F.coalesce(F.col("trainingEligible"), F.lit(False))
    return [
        pattern("sourceUrl", "^https://"), Rule("asset URL has the wrong form", F.regexp_like(F.coalesce("url", "thumbnailUrl"), F.lit("^https://"))), *required("creator", "license", "requiredAttribution", "hostSpecies"),
        Rule("diagnosticLabel does not name the record", F.contains("diagnosticLabel", F.col("slug"))), one_of("hostContext", "cannabis", "non-cannabis", "organism-only"), at_least("useLimitations", 1),
        one_of("displayPermission", *_PERMISSIONS), one_of("trainingPermission", *_PERMISSIONS),
        implies("approved without a hash", approved, F.regexp_like("sha256", F.lit("^[a-f0-9]{64}$")) & F.regexp_like("perceptualHash", F.lit("^dhash64:[a-f0-9]{16}$"))), implies("approved without a size", approved, (F.col("width") > 0) & (F.col("height") > 0)),
        implies("eligible without permission", eligible, F.col("trainingPermission") == "permitted"), implies("eligible without approval", eligible, F.col("reviewStatus") == "approved-training"),
        implies("eligible but not displayable", F.col("displayPermission") != "permitted", ~eligible), implies("another host is illustrative", F.col("hostContext") == "non-cannabis", (F.col("confirmation") == "illustrative") & ~eligible)]


def source_rules_of_records() -> list[Rule]:
    """Of records with arrays of sources: a reviewed one has some, each with an https URL, an ISO date and at least one claim."""
    reviewed = F.col("reviewStatus") == "reviewed"
    each = lambda f: F.forall("sources", f)
    return [
        implies("reviewed without a source", reviewed, F.size("sources") > 0), implies("source without an https URL", reviewed, each(lambda s: F.coalesce(F.regexp_like(s["url"], F.lit("^https://")), F.lit(False)))),
        implies("source without a date", reviewed, each(lambda s: F.coalesce(F.regexp_like(s["accessedDate"], F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.lit(False)))), implies("source without a claim", reviewed, each(lambda s: F.coalesce(F.size(s["supportedClaims"]) > 0, F.lit(False))))]


def binary_violations(records: DataFrame, files: DataFrame) -> DataFrame:
    """(dataset, row_key, rule) of records (id, path, sha256, license, sourceArticle, sourceGroupId, trainingEligible) against files (path, content): each is there, not empty, unchanged, not for training, and has its provenance."""
    have = files.select("path", F.sha2("content", 256).alias("_sha"), F.octet_length("content").alias("_size"))
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    there = F.coalesce(F.col("_size") > 0, F.lit(False))
    return violations(records.join(have, "path", "left"), "binaries", "id", [
        Rule("file missing or empty", there), implies("SHA-256 mismatch", there, F.col("_sha") == F.col("sha256")), Rule("trainingEligible is not false", F.col("trainingEligible") == F.lit(False)),
        Rule("license or source missing", full("license") & full("sourceArticle")), Rule("sourceGroupId missing", full("sourceGroupId"))]).unionByName(repeated(records, "binaries", "id"))


# What a case store checks, values of columns, and references between its tables (a null reference is no violation).
STORE_VALUES = {"case_media": {"media_type": ("image", "video")}, "case_messages": {"role": ("user", "reviewer", "system")}, "intervention_outcomes": {"outcome": ("better", "same", "worse", "unknown")}}
STORE_KEYS = (("case_media", "case_id", "diagnostic_cases", "case_id"), ("case_media", "parent_media_id", "case_media", "media_id"), ("inference_analyses", "case_id", "diagnostic_cases", "case_id"),
              ("inference_analyses", "supersedes_analysis_id", "inference_analyses", "analysis_id"), ("expert_reviews", "case_id", "diagnostic_cases", "case_id"), ("expert_reviews", "analysis_id", "inference_analyses", "analysis_id"),
              ("case_messages", "case_id", "diagnostic_cases", "case_id"), ("intervention_outcomes", "case_id", "diagnostic_cases", "case_id"), ("intervention_outcomes", "analysis_id", "inference_analyses", "analysis_id"))


def store_violations(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """(dataset, row_key, rule) of the tables of a case store that are given, each with its key."""
    found = [violations(rows, name, keys[name], [Rule(f"{f} is not allowed", F.col(f).isNull() | F.col(f).isin(*values)) for f, values in STORE_VALUES.get(name, {}).items()]) for name, rows in tables.items() if name in STORE_VALUES]
    found += [orphans(tables[rows], rows, keys[rows], field, tables[parents], parent) for rows, field, parents, parent in STORE_KEYS if rows in tables and parents in tables and field in tables[rows].columns]
    return reduce(DataFrame.unionByName, found)


# Content gates: what the text, lists and numbers of a record must be like.
def says(text: Column, name: str, *terms: str) -> Rule:
    return holds_all(text, name, *terms)


def matches(text: Column, name: str, regex: str) -> Rule:
    return Rule(name, F.regexp_like(F.lower(text), F.lit(regex)))


def lists_all(field: str, name: str, *entries: str) -> Rule:
    return Rule(name, F.size(F.array_except(F.array(*map(F.lit, entries)), field)) == 0)


def counts(field: str, name: str, n: int, exactly: bool = False) -> Rule:
    return Rule(name, F.size(field) == n if exactly else F.size(field) >= n)


def at_most(field: str, name: str, most: float) -> Rule:
    """No number above ``most``; a record without one passes."""
    return Rule(name, F.col(field).isNull() | (F.col(field) <= most))


def none_flagged(entries: str, name: str, flag: str) -> Rule:
    return Rule(name, F.forall(entries, lambda m: ~F.coalesce(m[flag], F.lit(False))))


def drift(new_sha: Column, old_sha: Column, new_hash: Column, old_hash: Column, same_size: Column) -> Column:
    """Whether a file fetched again is the one recorded: new, stable, re-encoded or drifted."""
    return F.when(old_sha.isNull(), "new").when(new_sha == old_sha, "stable").when(F.coalesce((new_hash == old_hash) & same_size, F.lit(False)), "re-encoded").otherwise("drift")


def recovered(new_sha: Column, sha: Column, new_hash: Column, expected_hash: Column, radius: int = 4) -> Column:
    """Whether a recovered file is accepted: the same bytes, or a picture within the radius of the expected one."""
    near = T.hamming(T.hex_bits(new_hash), T.hex_bits(expected_hash)) <= radius
    return F.coalesce(new_sha == sha, F.lit(False)) | F.coalesce(near, F.lit(False))
