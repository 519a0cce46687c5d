"""Validators, release gates, coverage audits and evaluation over the test tables, which stand for the files of a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebeam.operators import coverage, gates, ordered, packing
from sagebeam.operators import validation as V
from sagebeam.plans.tables import Entry, spread, table


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy("dataset", "rule").agg(F.count("*").alias("n"))


def _sql(cte: str, rules: dict[str, str], dataset: str, extra: str = "") -> str:
    """Counts of the rows that break each rule (name: the condition that must hold), null as broken."""
    parts = " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) AS n FROM r WHERE NOT coalesce({holds}, false)" for name, holds in rules.items())
    return f"{cte}, v AS ({parts}{extra}) SELECT '{dataset}' AS dataset, rule, n FROM v WHERE n > 0"


def _need(*fields: str) -> dict[str, str]:
    return {f"{f} is required": f"trim(CAST({f} AS VARCHAR)) <> ''" for f in fields}


_IDS = "CASE WHEN doc_id % 50 = 3 THEN 'DS-7' ELSE 'DS-' || lpad(CAST(doc_id % 900 AS VARCHAR), 3, '0') END"


def _dataset_id() -> Column:
    return F.when(F.col("doc_id") % 50 == 3, "DS-7").otherwise(F.concat(F.lit("DS-"), F.lpad((F.col("doc_id") % 900).cast("string"), 3, "0")))


def acquisition_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of the acquisition snapshot."""
    lang, source = F.col("lang"), F.col("source")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").alias("sheetRow"), F.col("doc_id").alias("order"), _dataset_id().alias("datasetId"), F.when(F.length("text") > 20, source).otherwise(" ").alias("dataset"),
        F.concat(F.when(source == "src1", "no url ").otherwise("https://x.org/"), F.col("doc_id")).alias("canonicalSource"), F.lit("1").alias("version"), F.lit("p").alias("expectedPackage"), F.lit("c").alias("repositoryChecksum"),
        F.when(lang == "en", "CC BY").when(lang == "de", "ShareAlike").otherwise("Verify per-item").alias("license"), F.when(source < "src14", "01_RAW_OPEN").when(source < "src17", "quarantine").otherwise("02").alias("destination"),
        F.when(source == "src2", "Quarantined").when(source == "src3", "runtime BLOCKED").otherwise("done").alias("acquisitionStatus"), F.when(lang == "en", "Verified").when(lang == "de", "verified, pending").otherwise("open").alias("integrityStatus"),
        F.lit("ok").alias("rightsStatus"), F.when(F.col("n_chars") > 200, "n").alias("criticalNotes"), F.concat(F.lit("f"), F.col("doc_id") % 700).alias("driveFolderId"))
    return _counted(V.violations(rows, "acquisition", "doc_id", V.acquisition_rules()).unionByName(V.repeated(rows, "acquisition", *V.ACQUISITION_UNIQUE)))


_ACQUISITION_ROWS = f"""
WITH r AS (SELECT doc_id, doc_id AS sheetRow, doc_id AS "order", {_IDS} AS datasetId, CASE WHEN length(text) > 20 THEN source ELSE ' ' END AS dataset, CASE WHEN source = 'src1' THEN 'no url ' ELSE 'https://x.org/' END || doc_id AS canonicalSource,
  CASE lang WHEN 'en' THEN 'cc by' WHEN 'de' THEN 'sharealike' ELSE 'verify per-item' END || ' ok' AS rights, CASE WHEN source < 'src14' THEN '01_raw_open' WHEN source < 'src17' THEN 'quarantine' ELSE '02' END AS lane,
  CASE source WHEN 'src2' THEN 'quarantined' WHEN 'src3' THEN 'runtime blocked' ELSE 'done' END AS status, lang = 'en' AS complete, CASE WHEN n_chars > 200 THEN 'n' END AS criticalNotes, 'f' || doc_id % 700 AS driveFolderId FROM documents)
"""
_UNIQUE = "".join(f" UNION ALL SELECT '{f} is not unique', count(*) FROM (SELECT {f} FROM r WHERE {f} IS NOT NULL GROUP BY 1 HAVING count(*) > 1) AS u_{f}" for f in V.ACQUISITION_UNIQUE)
_ACQUISITION = _sql(_ACQUISITION_ROWS, _need("dataset", "criticalNotes") | {
    "datasetId has the wrong form": "regexp_full_match(datasetId, 'DS-\\d{3,}')", "canonicalSource is no URL": "contains(canonicalSource, '://')",
    "open lane with restricted rights": "lane <> '01_raw_open' OR NOT regexp_matches(rights, 'sharealike|per-item')", "quarantined outside quarantine": "NOT contains(status, 'quarantine') OR contains(lane, 'quarantine')",
    "blocked at run time but complete": "NOT contains(status, 'runtime') OR NOT complete"}, "acquisition", _UNIQUE)


def source_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of the source registry."""
    lang, source = F.col("lang"), F.col("source")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", _dataset_id().alias("id"), source.alias("name"), F.lit("d").alias("domain"), F.when(lang == "en", "YES").when(lang == "de", "NO").when(lang == "fr", "PARTIAL").otherwise("MAYBE").alias("cannabisSpecific"),
        F.lit("m").alias("modality"), F.when(F.col("n_chars") > 150, "t").otherwise("").alias("primaryTask"), F.when(source == "src2", "Unknown").otherwise("CC BY").alias("license"), F.lit("yes").alias("academicUse"), F.lit("yes").alias("rawRedistribution"),
        F.lit("yes").alias("publicModelDeployment"), F.concat(F.lit("P"), F.col("n_chars") % 5).alias("priority"), F.when(source == "src4", "x.org").otherwise("https://x.org").alias("sourceUrl"), F.when(lang == "de", "Verify first").otherwise("known").alias("provenanceStatus"))
    return _counted(V.violations(rows, "sources", "doc_id", V.source_rules()).unionByName(V.repeated(rows, "sources", *V.SOURCE_UNIQUE)))


_SOURCES = _sql(f"WITH r AS (SELECT {_IDS} AS id, lang, source, CASE WHEN n_chars > 150 THEN 't' ELSE '' END AS primaryTask, n_chars % 5 AS p FROM documents)", _need("primaryTask") | {
    "id has the wrong form": "regexp_full_match(id, 'DS-\\d{3,}')", "cannabisSpecific is not allowed": "lang IN ('en', 'de', 'fr')", "priority is not allowed": "p < 4", "sourceUrl is no URL": "source <> 'src4'",
    "unknown rights need a look at provenance": "source <> 'src2' OR lang = 'de'"}, "sources", " UNION ALL SELECT 'id is not unique', count(*) FROM (SELECT id FROM r GROUP BY 1 HAVING count(*) > 1) AS u")


def permission_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as permission requests."""
    lang, source, n = F.col("lang"), F.col("source"), F.col("n_chars")
    some = lambda condition: F.when(condition, F.array(F.lit("x"))).otherwise(F.expr("cast(array() as array<string>)"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("PERM-"), F.when(source == "src6", "X").otherwise(F.lpad((F.col("doc_id") % 900).cast("string"), 3, "0"))).alias("requestId"), _dataset_id().alias("datasetId"), source.alias("source"), F.concat(F.lit("P"), n % 5).alias("priority"),
        F.when(lang == "en", "REQUEST_DRAFT_READY").when(lang == "de", "APPROVED").when(lang == "fr", "SENT").otherwise("LOST").alias("status"), F.struct(F.when(source == "src1", " ").otherwise("somebody").alias("nameOrOrganization")).alias("contact"),
        some(n > 100).alias("requestedAssets"), some(n > 120).alias("requestedMetadata"), some(n > 140).alias("rightsRequested"), F.lit("r").alias("acquisitionRule"), F.lit("n").alias("notes"),
        F.when(source < "src12", "2024-01-01").otherwise("").alias("requestedDate"), F.when(source < "src15", "2024-02-01").alias("responseDate"))
    return _counted(V.violations(rows, "permissions", "doc_id", V.permission_rules()).unionByName(V.repeated(rows, "permissions", *V.PERMISSION_UNIQUE)))


_PERMISSIONS = _sql(f"WITH r AS (SELECT 'PERM-' || CASE WHEN source = 'src6' THEN 'X' ELSE lpad(CAST(doc_id % 900 AS VARCHAR), 3, '0') END AS requestId, {_IDS} AS datasetId, lang, source, n_chars AS n FROM documents)", {
    "requestId has the wrong form": "regexp_full_match(requestId, 'PERM-\\d{3}')", "datasetId has the wrong form": "regexp_full_match(datasetId, 'DS-\\d{3,}')", "priority is not allowed": "n % 5 < 4", "status is not allowed": "lang <> 'es'",
    "requestedAssets has fewer than 1 entries": "n > 100", "requestedMetadata has fewer than 1 entries": "n > 120", "rightsRequested has fewer than 1 entries": "n > 140", "contact.nameOrOrganization is required": "source <> 'src1'",
    "a draft has no request date": "lang <> 'en' OR source >= 'src12'", "an approval has a response date": "lang <> 'de' OR source < 'src15'"}, "permissions",
    "".join(f" UNION ALL SELECT '{f} is not unique', count(*) FROM (SELECT {f} FROM r GROUP BY 1 HAVING count(*) > 1) AS u_{f}" for f in V.PERMISSION_UNIQUE))


def transfer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as versions of the transfer policy, each with other faults."""
    key = F.col("r_regionkey")
    words = {"DS-140": "overlap and double-count", "DS-141": "64 sourceGroupId in one split", "DS-142": "white-background and natural-background", "DS-146": "hard negatives, harmful-insect"}
    entry = lambda d: F.struct(F.array(F.lit("a role")).alias("role"), F.when(key == 1, F.array(F.lit("a rule"))).otherwise(F.array(F.lit(words.get(d, "a rule")))).alias("rules"), F.array(*[F.lit(x) for x in ("lacewing", "hoverfly", "Lady beetle")]).alias("beneficialClasses"))
    datasets = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f"DS-{n}"), entry(f"DS-{n}")) for n in range(137, 147)]), lambda e: (key != 2) | (e["col1"] != "DS-139")))
    uses = F.array(*map(F.lit, "abcd"))
    rows = table(spark, sf_dir, "region").select(
        "r_regionkey", F.when(key != 3, "1").alias("policyVersion"), F.struct(F.array(*[F.lit(f"DS-{n}") for n in range(137, 147)]).alias("datasetIds")).alias("scope"),
        F.struct((key == 4).alias("cannabisCausalGroundTruth"), F.lit(True).alias("preserveOriginalSourceLabels"), F.lit(True).alias("requireCannabisSpecificConfirmationForCannabisEtiology"), F.lit(True).alias("requireSha256AndPerceptualDedupBeforeTraining"),
                 F.lit(False).alias("allowIndependentSampleInflationFromDerivatives"), F.when(key == 4, F.slice(uses, 1, 3)).otherwise(uses).alias("allowedUses"), uses.alias("forbiddenUses")).alias("invariants"), datasets.alias("datasetRules"))
    return V.violations(rows, "transfer", "r_regionkey", V.transfer_rules()).select("row_key", "rule")


_TRANSFER = """
SELECT CAST(r_regionkey AS VARCHAR) AS row_key, unnest(CASE r_regionkey WHEN 1 THEN ['DS-140 rules incomplete', 'DS-141 rules incomplete', 'DS-142 rules incomplete', 'DS-146 rules incomplete'] WHEN 2 THEN ['DS-139 role missing', 'DS-139 rules missing']
  WHEN 3 THEN ['policyVersion is required'] WHEN 4 THEN ['invariants.cannabisCausalGroundTruth is not false', 'invariants.allowedUses has fewer than 4 entries'] ELSE [] END) AS rule FROM region
"""


def persistence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as fetched media that are to be kept."""
    i = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(
        i.alias("id"), F.lit("slug").alias("issue_slug"), F.concat(F.when(i % 5 == 0, "http").otherwise("https"), F.lit("://"), F.when(i % 7 == 0, F.regexp_extract("url", "://([^/]+)/", 1)).otherwise("www.mdpi.com"), F.lit("/"), i).alias("image_url"), F.col("url").alias("source_article"),
        F.when(i % 11 == 0, "").otherwise("c").alias("caption"), F.lit("somebody").alias("creator"), F.when(i % 3 == 0, "CC BY-NC").otherwise("CC BY 4.0").alias("license"), F.when(i % 13 == 0, "training").otherwise("reference-only").alias("intended_use"),
        F.when(i % 4 == 0, "text/html").otherwise("image/png").alias("content_type"), F.when(i % 6 == 0, 0).otherwise(F.length("html") * 3000).alias("byte_size"))
    return _counted(V.violations(rows, "kept", "id", V.persistence_rules()))


_PERSISTENCE = _sql("WITH r AS (SELECT page_id AS i, length(html) AS n FROM pages)", {
    "caption is required": "i % 11 <> 0", "intended_use is not allowed": "i % 13 <> 0", "license is not allowed": "i % 3 <> 0", "image_url is not on an allowed host": "i % 5 <> 0 AND i % 7 <> 0",
    "content_type is no image": "i % 4 <> 0", "byte_size is not from 1 to 20000000": "i % 6 <> 0 AND n > 0 AND n * 3000 <= 20000000"}, "kept")


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, one = F.col("n_chars"), F.array(F.lit("x"))
    none = F.expr("cast(array() as array<string>)")
    lists = [F.when(n % 17 != k, one).alias(f) for k, f in enumerate(f for f in V.PROFILE_LISTS if f != "sources")]
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.when(n % 19 != 1, F.concat(F.lit("s"), F.col("doc_id") % 800)).alias("slug"), F.when(n % 19 == 2, "").otherwise(F.col("source")).alias("name"), F.col("lang").alias("category"), F.lit("low").alias("severity"),
        F.lit("reviewed").alias("reviewStatus"), F.when(F.length("text") > 60, F.col("text")).alias("summary"), *lists, F.when(n % 23 == 0, none).otherwise(one).alias("sources"))


def export_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as profiles before an export (nothing may be missing) and in a release (no text may be empty)."""
    rows = V.refuse_partial(_profiles(spark, sf_dir))
    found = V.violations(rows, "export", "id", V.export_rules()).unionByName(V.violations(rows, "release", "id", V.release_rules())).unionByName(V.repeated(rows, "export", "id", "slug"))
    return _counted(found)


_LISTS = [f for f in V.PROFILE_LISTS if f != "sources"]
_EXPORT = f"""
WITH r AS (SELECT doc_id, n_chars AS n, length(text) AS long FROM documents),
c AS ({" UNION ALL ".join(f"SELECT dataset, '{f} is missing' AS rule, count(*) FILTER (n % 17 = {k}) AS n FROM r, (VALUES ('export'), ('release')) AS d(dataset) GROUP BY dataset" for k, f in enumerate(_LISTS))}
  UNION ALL SELECT dataset, 'slug is missing', count(*) FILTER (n % 19 = 1) FROM r, (VALUES ('export'), ('release')) AS d(dataset) GROUP BY dataset
  UNION ALL SELECT dataset, 'summary is missing', count(*) FILTER (long <= 60) FROM r, (VALUES ('export'), ('release')) AS d(dataset) GROUP BY dataset
  UNION ALL SELECT 'release', 'name is missing', count(*) FILTER (n % 19 = 2) FROM r UNION ALL SELECT 'export', 'sources has fewer than 1 entries', count(*) FILTER (n % 23 = 0) FROM r
  UNION ALL SELECT 'export', 'slug is not unique', count(*) FROM (SELECT doc_id % 800 FROM r WHERE n % 19 <> 1 GROUP BY 1 HAVING count(*) > 1) AS u)
SELECT * FROM c WHERE n > 0
"""


def provenance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as media of records: provenance, permissions, hashes and what these rule out, and their uniqueness."""
    lang, source, n = F.col("lang"), F.col("source"), F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("slug").alias("slug"), F.when(source == "src1", "http://x").otherwise("https://x").alias("sourceUrl"), F.when(source < "src15", "https://y").alias("url"), F.when(source < "src18", "https://z").alias("thumbnailUrl"),
        F.when(n % 9 == 0, " ").otherwise("c").alias("creator"), F.lit("l").alias("license"), F.lit("a").alias("requiredAttribution"), F.lit("h").alias("hostSpecies"), F.when(n % 11 == 0, "other").otherwise("slug seen").alias("diagnosticLabel"),
        F.when(lang == "en", "cannabis").when(lang == "de", "non-cannabis").otherwise("organism-only").alias("hostContext"), F.when(n % 13 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("x"))).alias("useLimitations"),
        F.when(lang == "fr", "no").when(lang == "es", "not-permitted").otherwise("permitted").alias("displayPermission"), F.when(source < "src13", "permitted").otherwise("unknown").alias("trainingPermission"),
        F.when(lang == "es", "pending").when(n > 1000, "approved-training").otherwise("approved-reference").alias("reviewStatus"), F.sha2("text", 256).alias("sha256"), F.concat(F.lit("dhash64:"), F.substring(F.sha2("text", 256), 1, F.when(n % 7 == 0, 15).otherwise(16))).alias("perceptualHash"),
        (n % 5).alias("width"), F.lit(1).alias("height"), (n % 3 == 0).alias("trainingEligible"), F.when(n % 2 == 0, "illustrative").otherwise("lab").alias("confirmation"))
    return _counted(V.violations(rows, "media", "doc_id", V.provenance_rules()).unionByName(V.repeated(rows, "media", "sha256")))


_PROVENANCE = _sql("WITH r AS (SELECT doc_id, lang, source, n_chars AS n, n_chars % 3 = 0 AS e, lang <> 'es' AS approved, sha256(text) AS sha256 FROM documents)", {
    "sourceUrl has the wrong form": "source <> 'src1'", "asset URL has the wrong form": "source < 'src18'", "creator is required": "n % 9 <> 0", "diagnosticLabel does not name the record": "n % 11 <> 0", "useLimitations has fewer than 1 entries": "n % 13 <> 0",
    "displayPermission is not allowed": "lang <> 'fr'", "approved without a hash": "NOT approved OR n % 7 <> 0", "approved without a size": "NOT approved OR n % 5 > 0", "eligible without permission": "NOT e OR source < 'src13'",
    "eligible without approval": "NOT e OR (approved AND n > 1000)", "eligible but not displayable": "lang IN ('en', 'de') OR NOT e", "another host is illustrative": "lang <> 'de' OR (n % 2 = 0 AND NOT e)"}, "media",
    " UNION ALL SELECT 'sha256 is not unique', count(*) FROM (SELECT sha256 FROM r GROUP BY 1 HAVING count(*) > 1) AS u")


def split_implications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as media with splits: forms of hashes, and what eligibility and the locked split imply."""
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.lit("dhash64:0123456789abcdef").alias("perceptualHash"), (n % 3 == 0).alias("trainingEligible"), F.when(F.col("lang") == "en", "permitted").otherwise("unknown").alias("trainingPermission"),
        F.when(n % 4 == 0, "locked-evaluation").when(n % 4 == 1, "train").when(n % 4 == 2, "none").alias("datasetSplit"))
    return _counted(V.violations(rows, "splits", "doc_id", V.media_rules()))


_IMPLIED = _sql("WITH r AS (SELECT n_chars AS n, n_chars % 3 = 0 AS e, lang FROM documents)", {
    "eligible without permission": "NOT e OR lang = 'en'", "eligible without a split": "NOT e OR n % 4 IN (0, 1)", "locked evaluation is not for training": "n % 4 <> 0 OR NOT e"}, "splits")


def reviewed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records with their orders as sources."""
    entry = F.struct(F.when(F.col("o_orderpriority") == "5-LOW", "http://x").otherwise("https://x").alias("url"), F.when(F.col("o_orderstatus") == "P", "1.2.3").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("accessedDate"),
                     F.when(F.col("o_totalprice") < 5000, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("x"))).alias("supportedClaims"))
    listed = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(entry).alias("found"))
    rows = table(spark, sf_dir, "customer").join(listed, "c_custkey", "left").withColumn("sources", F.coalesce("found", F.slice(F.array(entry_of_none()), 1, 0))).withColumn("reviewStatus", F.when(F.col("c_mktsegment") != "BUILDING", "reviewed").otherwise("draft"))
    return _counted(V.violations(rows, "records", "c_custkey", V.source_rules_of_records()))


def entry_of_none() -> Column:
    """A source of the right type whose fields are null."""
    return F.struct(F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("accessedDate"), F.lit(None).cast("array<string>").alias("supportedClaims"))


_REVIEWED = _sql("""
WITH r AS (SELECT c_custkey, c_mktsegment <> 'BUILDING' AS reviewed, count(o_orderkey) AS n, count(*) FILTER (o_orderpriority = '5-LOW') AS bad_url, count(*) FILTER (o_orderstatus = 'P') AS bad_date, count(*) FILTER (o_totalprice < 5000) AS bad_claim
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)""", {
    "reviewed without a source": "NOT reviewed OR n > 0", "source without an https URL": "NOT reviewed OR bad_url = 0", "source without a date": "NOT reviewed OR bad_date = 0", "source without a claim": "NOT reviewed OR bad_claim = 0"}, "records")


def content_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records with texts, lists, caps and media that gates ask for."""
    words = F.array_distinct(F.split(F.lower("text"), " "))
    shown = F.struct((F.col("n_chars") > 4000).alias("trainingEligible"))
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", "text", words.alias("words"), (F.col("n_chars") / 5000).alias("cap"), F.array(shown, shown).alias("media"), F.split("text", "\n").alias("lines"))
    rules = [V.says(F.col("text"), "text names both", "the", "And"), V.matches(F.col("text"), "text has a run", "e[rn] [a-d]"), V.lists_all("words", "words lack some", "the", "de"), V.counts("lines", "few lines", 3), V.counts("lines", "not one line", 1, exactly=True), V.at_most("cap", "cap too high", 0.65), V.none_flagged("media", "media flagged", "trainingEligible")]
    return _counted(V.violations(rows, "records", "doc_id", rules))


_CONTENT = _sql("WITH r AS (SELECT lower(text) AS t, list_distinct(string_split(lower(text), ' ')) AS w, n_chars AS n, len(string_split(text, chr(10))) AS lines FROM documents)", {
    "text names both": "contains(t, 'the') AND contains(t, 'and')", "text has a run": "regexp_matches(t, 'e[rn] [a-d]')", "words lack some": "list_contains(w, 'the') AND list_contains(w, 'de')", "few lines": "lines >= 3", "not one line": "lines = 1",
    "cap too high": "n / 5000.0 <= 0.65", "media flagged": "n <= 4000"}, "records")


def gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records under a table of rules: no long word of the benchmark in any, and what sources and languages must hold; how many records fail each rule."""
    words = F.array_distinct(F.split(F.lower("text"), " "))
    docs = spread(table(spark, sf_dir, "documents"))
    scopes = F.array(F.concat(F.lit("slug:"), "source"), F.concat(F.lit("category:"), "lang"), F.lit("all"))
    fields = docs.select("doc_id", "source", "lang", "text", "n_chars", F.explode(F.array(*map(F.lit, ("text", "words", "lines", "cap")))).alias("field"))
    # Each row makes the items of its own field, and none where only fields are asked for.
    field = F.col("field")
    items = F.when(field == "text", F.array("text")).when(field == "words", words).when(field == "lines", F.split("text", "\n")).otherwise(F.expr("cast(array() as array<string>)"))
    facets = fields.select(F.col("doc_id").alias("record_id"), F.array_compact(scopes).alias("scopes"), field, items.alias("items"), F.when(field == "cap", F.col("n_chars") / 5000).alias("number"))
    long_words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("value")).where("length(value) >= 6").distinct()
    lacks = long_words.select(F.concat(F.lit("lacks "), "value").alias("rule"), F.lit("all").alias("scope"), F.lit("text").alias("field"), F.lit("lacks").alias("kind"), "value", F.lit(None).cast("double").alias("number"))
    sources, langs = (docs.select(F.concat(F.lit(tag), c).alias("scope")).where("scope is not null").distinct() for tag, c in (("slug:", "source"), ("category:", "lang")))
    rule = lambda rows, field, kind, value=None, number=None: rows.select(F.lit(f"{field} {kind} {value if number is None else number}").alias("rule"), "scope", F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.lit(value).cast("string").alias("value"), F.lit(number).cast("double").alias("number"))
    rules = lacks
    for more in (
        rule(sources, "text", "holds", "the"), rule(sources, "text", "matches", "e[rn] [a-d]"), rule(langs, "text", "matches_case", "^[A-Z]"), rule(langs, "words", "lists", "de"), rule(langs, "words", "none", "the"), rule(langs, "words", "some", "ou"),
        rule(sources, "words", "is", "the"), rule(langs, "lines", "size", number=1), rule(sources, "lines", "least", number=3), rule(langs, "cap", "most", number=0.65), rule(sources, "licence", "is", "open")):
        rules = rules.unionByName(more)
    return gates.violations(facets, rules).groupBy("rule", "scope").agg(F.count("*").alias("n"), F.count("record_id").alias("n_records"))


_GATES = """
WITH r AS (SELECT doc_id, 'slug:' || source AS s, 'category:' || lang AS c, text, lower(text) AS t, list_distinct(string_split(lower(text), ' ')) AS w, string_split(lower(text), ' ')[1] AS first, len(string_split(text, chr(10))) AS lines, n_chars / 5000.0 AS cap FROM documents),
words AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS v FROM benchmark),
v AS (
  SELECT 'lacks ' || v AS rule, 'all' AS scope, doc_id FROM r JOIN words ON length(v) >= 6 AND contains(t, v)
  UNION ALL SELECT 'text holds the', s, doc_id FROM r WHERE NOT contains(t, 'the')
  UNION ALL SELECT 'text matches e[rn] [a-d]', s, doc_id FROM r WHERE NOT regexp_matches(t, 'e[rn] [a-d]')
  UNION ALL SELECT 'text matches_case ^[A-Z]', c, doc_id FROM r WHERE NOT regexp_matches(text, '^[A-Z]')
  UNION ALL SELECT 'words lists de', c, doc_id FROM r WHERE NOT list_contains(w, 'de')
  UNION ALL SELECT 'words none the', c, doc_id FROM r WHERE list_contains(w, 'the')
  UNION ALL SELECT 'words some ou', c, doc_id FROM r WHERE len(list_filter(w, lambda x: contains(x, 'ou'))) = 0
  UNION ALL SELECT 'words is the', s, doc_id FROM r WHERE first <> 'the'
  UNION ALL SELECT 'lines size 1', c, doc_id FROM r WHERE lines <> 1
  UNION ALL SELECT 'lines least 3', s, doc_id FROM r WHERE lines < 3
  UNION ALL SELECT 'cap most 0.65', c, doc_id FROM r WHERE cap > 0.65
  UNION ALL SELECT DISTINCT 'licence is open', s, CAST(NULL AS BIGINT) FROM r)
SELECT rule, scope, count(*) AS n, count(doc_id) AS n_records FROM v WHERE scope IS NOT NULL GROUP BY rule, scope
"""


def catalogue_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records of the catalogue under its own gates: each stands for the record that its number picks, its turns for texts and media."""
    slugs = sorted(gates.RECORD_GATES)
    number, turns = F.col("conv_id"), table(spark, sf_dir, "conversations")
    of = lambda role: F.array_compact(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]))
    whole = turns.groupBy("conv_id").agg(of("user").alias("confirmation"), of("assistant").alias("warnings"), F.array_sort(F.collect_list("turn")).alias("turns"))
    records = whole.select(
        F.get(F.array(*[F.lit(s) for s in slugs]), F.pmod(number, F.lit(len(slugs))).cast("int")).alias("slug"), F.when(F.size("turns") > 3, "Bacterial pathogen").otherwise("Virus").alias("category"), F.when(F.size("turns") > 2, "reviewed").otherwise("draft").alias("reviewStatus"),
        F.lit("Tetranychus urticae").alias("scientificName"), (F.size("turns") / 10).alias("photoOnlyMaxConfidence"), "confirmation", "warnings", F.array(F.lit("Iron deficiency"), F.lit("Pythium root rot")).alias("lookAlikes"),
        F.transform("turns", lambda t: F.struct(t.cast("string").alias("id"), (t > 4).alias("trainingEligible"), F.array(F.lit("Four panels")).alias("useLimitations"))).alias("media"),
        F.expr("array(named_struct('doi', cast(null as string), 'url', 'https://content.ces.ncsu.edu/twospotted-spider-mite'))").alias("sources"))
    return gates.violations(gates.catalogue_facets(records), gates.catalogue_rules(spark)).groupBy("rule", "scope").agg(F.count("*").alias("n"), F.count("record_id").alias("n_records"))


def _gates_sql() -> str:
    tests = {
        "holds": "NOT contains({t}, '{v}')", "matches": "NOT regexp_matches({t}, '{v}')", "matches_case": "NOT regexp_matches({x}, '{v}')", "lists": "NOT list_contains({l}, '{v}')", "is": "coalesce({l}[1] <> '{v}', true)", "some": "len(list_filter({l}, lambda y: contains(y, '{v}'))) = 0",
        "none": "list_contains({l}, '{v}')", "size": "len({l}) <> {v}", "most": "cap > {v}"}
    lists = {"media.id": "ids", "media.trainingEligible": "flags", "sources.doi": "[]", "sources.url": "['https://content.ces.ncsu.edu/twospotted-spider-mite']", "lookAlikes": "['Iron deficiency', 'Pythium root rot']", "scientificName": "['Tetranychus urticae']", "reviewStatus": "[status]", "photoOnlyMaxConfidence": "[]"}
    out = []
    for prefix, all_gates in (("slug", gates.RECORD_GATES), ("category", gates.CATEGORY_GATES)):
        for name, asked in all_gates.items():
            for field, kind, value in asked:
                medium = field.startswith("media.") and field[6].isdigit()
                items = "['Four panels']" if medium else lists.get(field, field)
                failed = tests[kind].format(t=f"lower(array_to_string({items}, ' '))", x=f"array_to_string({items}, ' ')", l=items, v=value)
                there = f" AND len(ids) > {field[6]}" if medium else ""
                rule, scope = f"{name}: {field} {kind} {value}", f"{prefix}:{name}"
                out.append(f"SELECT '{rule}' AS rule, '{scope}' AS scope, 1 AS known FROM r WHERE {prefix} = '{name}'{there} AND {failed}")
                if prefix == "slug":
                    out.append(f"SELECT '{rule}', '{scope}', NULL WHERE NOT EXISTS (SELECT 1 FROM r WHERE slug = '{name}'{there})")
    slugs = ", ".join(f"'{s}'" for s in sorted(gates.RECORD_GATES))
    return f"""
WITH c AS (
  SELECT conv_id, list(text ORDER BY turn, text) FILTER (role = 'user' AND text IS NOT NULL) AS confirmation, list(text ORDER BY turn, text) FILTER (role = 'assistant' AND text IS NOT NULL) AS warnings, list(CAST(turn AS VARCHAR) ORDER BY turn) AS ids,
    list(CASE WHEN turn > 4 THEN 'true' ELSE 'false' END ORDER BY turn) AS flags FROM conversations GROUP BY conv_id),
r AS (SELECT [{slugs}][conv_id % {len(gates.RECORD_GATES)} + 1] AS slug, CASE WHEN len(ids) > 3 THEN 'Bacterial pathogen' ELSE 'Virus' END AS category, CASE WHEN len(ids) > 2 THEN 'reviewed' ELSE 'draft' END AS status, len(ids) / 10.0 AS cap,
  coalesce(confirmation, []) AS confirmation, coalesce(warnings, []) AS warnings, ids, flags FROM c)
SELECT rule, scope, count(*) AS n, count(known) AS n_records FROM ({" UNION ALL ".join(out)}) GROUP BY rule, scope
"""


def binary_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as binaries of a release: records against files, some of which are lost, empty or changed."""
    n, lang = F.col("n_chars"), F.col("lang")
    docs = table(spark, sf_dir, "documents")
    records = docs.select(
        F.when(n % 29 == 0, F.lit(-1)).otherwise(F.col("doc_id")).alias("id"), F.concat(F.lit("images/"), F.col("doc_id")).alias("path"), F.sha2("text", 256).alias("sha256"), F.when(lang == "fr", "").otherwise("CC BY").alias("license"),
        F.when(n % 5 != 0, "a").alias("sourceArticle"), F.when(n % 7 != 0, F.col("source")).alias("sourceGroupId"), (n % 11 == 0).alias("trainingEligible"))
    files = docs.where(n % 13 != 0).select(F.concat(F.lit("images/"), F.col("doc_id")).alias("path"), F.when(n % 17 == 0, "").when(n % 19 == 0, "changed").otherwise(F.col("text")).cast("binary").alias("content"))
    return _counted(V.binary_violations(records, files))


_BINARIES = _sql("WITH r AS (SELECT n_chars AS n, lang, n_chars % 13 <> 0 AND n_chars % 17 <> 0 AND (n_chars % 19 = 0 OR text <> '') AS there FROM documents)", {
    "file missing or empty": "there", "SHA-256 mismatch": "NOT there OR n % 19 <> 0", "trainingEligible is not false": "n % 11 <> 0", "license or source missing": "lang <> 'fr' AND n % 5 <> 0", "sourceGroupId missing": "n % 7 <> 0"}, "binaries",
    " UNION ALL SELECT 'id is not unique', CASE WHEN count(*) > 1 THEN 1 ELSE 0 END FROM r WHERE n % 29 = 0")


def store_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the messages of cases, and events as the cases: allowed roles and references."""
    cases = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id")).distinct()
    messages = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("conv_id").alias("case_id"), F.when(F.col("role") == "assistant", "reviewer").when(F.length("text") > 600, "guest").otherwise(F.col("role")).alias("role"))
    outcomes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("outcome_id"), F.col("doc_id").alias("case_id"), F.when(F.col("lang") == "en", "better").when(F.col("lang") == "de", "best").alias("outcome"))
    keys = {"diagnostic_cases": "case_id", "case_messages": "message_id", "intervention_outcomes": "outcome_id"}
    return _counted(V.store_violations({"diagnostic_cases": cases, "case_messages": messages, "intervention_outcomes": outcomes}, keys))


_STORE = """
WITH v AS (
  SELECT 'case_messages' AS dataset, 'role is not allowed' AS rule FROM conversations WHERE role <> 'assistant' AND length(text) > 600
  UNION ALL SELECT 'intervention_outcomes', 'outcome is not allowed' FROM documents WHERE lang = 'de'
  UNION ALL SELECT 'case_messages', 'case_id has no parent' FROM conversations WHERE conv_id NOT IN (SELECT user_id FROM events)
  UNION ALL SELECT 'intervention_outcomes', 'case_id has no parent' FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events))
SELECT dataset, rule, count(*) AS n FROM v GROUP BY ALL
"""

_TOLD = {"manifest.diagnosticProfileCount": 1500, "manifest.evidenceSourceCount": 15000, "modelReadiness.visionLayer.totalReferenceImages": 2100, "splitManifest.counts.totalTrainingEligible": 0, "manifest.referencePanelCropCount": 99}


def release_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the tables as those of a release against every place that repeats them."""
    actual = None
    for metric, name in {"profiles": "customer", "sources": "orders", "profileMedia": "documents", "trainingEligible": "labels", "originals": "part", "crops": "supplier"}.items():
        one = table(spark, sf_dir, name).agg(F.count("*").alias("value")).select(F.lit(metric).alias("metric"), "value")
        actual = one if actual is None else actual.unionByName(one)
    return V.release_counts(actual, spark.createDataFrame(list(_TOLD.items()), "label string, value long"))


_RELEASE = f"""
WITH a(metric, actual) AS (SELECT 'profiles', count(*) FROM customer UNION ALL SELECT 'sources', count(*) FROM orders UNION ALL SELECT 'profileMedia', count(*) FROM documents UNION ALL SELECT 'trainingEligible', count(*) FROM labels
  UNION ALL SELECT 'originals', count(*) FROM part UNION ALL SELECT 'crops', count(*) FROM supplier UNION ALL SELECT 'totalReferenceImages', (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier)),
l(metric, label) AS (VALUES {", ".join(f"('{m}', '{x}')" for m, xs in V.RELEASE_METRICS.items() for x in xs)}),
t(label, told) AS (VALUES {", ".join(f"('{k}', {v}::BIGINT)" for k, v in _TOLD.items())})
SELECT l.label, actual, told, coalesce(actual = told, false) AS agrees FROM l JOIN a USING (metric) LEFT JOIN t ON t.label = l.label
"""


def split_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as split manifests: what is wrong where none of a source's documents is eligible."""
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if((F.col("lang") == "es") & (F.col("n_chars") > 9000)).alias("eligible"), F.count_if(F.col("n_chars") > 15_000).alias("train"), F.count_if(F.col("n_chars") > 18_000).alias("test"))
    found = V.split_gate(F.col("eligible"), F.col("source") < "src12", F.col("source") > "src5", F.col("train"), F.col("test"))
    return docs.select("source", "eligible", F.array_join(found, "|").alias("wrong"))


_GATE = """
WITH d AS (SELECT source, count(*) FILTER (lang = 'es' AND n_chars > 9000) AS eligible, count(*) FILTER (n_chars > 15000) + count(*) FILTER (n_chars > 18000) AS total FROM documents GROUP BY source)
SELECT source, eligible, CASE WHEN eligible > 0 THEN '' ELSE concat_ws('|', CASE WHEN source > 'src5' THEN 'model readiness must remain false' END, CASE WHEN source < 'src12' OR total <> 0 THEN 'splits must remain empty and blocked' END) END AS wrong FROM d
"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records: orders are sources, priorities indicators, statuses exclusions, filled ones approved pictures."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("sources"), F.countDistinct("o_orderpriority").alias("indicators"), F.countDistinct("o_orderstatus").alias("exclusions"), F.count_if(F.col("o_orderstatus") == "F").alias("approved"), F.countDistinct(F.year("o_orderdate")).alias("confirmation"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").fillna(0, ["sources", "indicators", "exclusions", "approved", "confirmation"])


def _counters() -> dict[str, Column]:
    c = F.col
    return coverage.audit_counters(c("approved"), c("approved") + F.when(c("c_acctbal") > 9000, 1).otherwise(0), c("sources"), c("indicators"), c("exclusions"), c("exclusions") + 1, c("confirmation"))


def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of the coverage audit by market segment, with the percent of a target that one segment lacks."""
    names = spark.createDataFrame([("AUTOMOBILE", 4000), ("BUILDING", 3000), ("FURNITURE", 2000), ("HOUSEHOLD", None), ("MACHINERY", 0), ("NOBODY", 10)], "c_mktsegment string, target long")
    return coverage.audit(names, _audited(spark, sf_dir), "c_mktsegment", "approved", "target", _counters())


_AUDITED = """
WITH o AS (SELECT o_custkey, count(*) AS sources, count(DISTINCT o_orderpriority) AS indicators, count(DISTINCT o_orderstatus) AS exclusions, count(*) FILTER (o_orderstatus = 'F') AS approved, count(DISTINCT year(o_orderdate)) AS confirmation FROM orders GROUP BY 1),
c AS (SELECT c_mktsegment, c_custkey, c_acctbal, coalesce(sources, 0) AS sources, coalesce(indicators, 0) AS indicators, coalesce(exclusions, 0) AS exclusions, coalesce(approved, 0) AS approved, coalesce(confirmation, 0) AS confirmation,
  coalesce(approved, 0) + CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END AS resolved FROM customer LEFT JOIN o ON o_custkey = c_custkey)
"""
_COUNTERS = """count(*) FILTER (resolved > 0) AS with_visual, count(*) FILTER (approved = 0) AS without_approved, count(*) FILTER (resolved = 0) AS without_visual, count(*) FILTER (sources = 0) AS without_sources,
  count(*) FILTER (indicators < 2) AS weak_indicators, count(*) FILTER (exclusions < 2) AS weak_exclusions, count(*) FILTER (exclusions + 1 < 2) AS weak_look_alikes, count(*) FILTER (confirmation < 2) AS weak_confirmation"""
_COVERAGE_AUDIT = _AUDITED + f""",
t(seg, target) AS (VALUES ('AUTOMOBILE', 4000::BIGINT), ('BUILDING', 3000), ('FURNITURE', 2000), ('HOUSEHOLD', NULL), ('MACHINERY', 0), ('NOBODY', 10)),
j AS (SELECT seg AS c_mktsegment, target, count(c_custkey) AS records, CAST(coalesce(sum(approved), 0) AS BIGINT) AS approved_images, {_COUNTERS} FROM t LEFT JOIN c ON c_mktsegment = seg GROUP BY seg, target)
SELECT *, CASE WHEN target > 0 THEN floor((1000.0 * approved_images)::DOUBLE / target + 0.5) / 10 END::DOUBLE AS percent FROM j
"""


def global_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of conditional counts over all records."""
    rows = _audited(spark, sf_dir)
    return coverage.totals(rows, {"reviewed": F.col("c_mktsegment") != "BUILDING", "sourced": F.col("sources") > 0, **_counters(), "with_canonical_id": F.col("c_acctbal") > 0, "with_policy": F.col("c_nationkey") < 5})


_TOTALS = _AUDITED + f"""
SELECT count(*) AS n, count(*) FILTER (c.c_mktsegment <> 'BUILDING') AS reviewed, count(*) FILTER (sources > 0) AS sourced, {_COUNTERS}, count(*) FILTER (c.c_acctbal > 0) AS with_canonical_id, count(*) FILTER (c_nationkey < 5) AS with_policy
FROM c JOIN customer USING (c_custkey)
"""


def shard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts packed into four shards by size: bytes, files and pictures of each."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.col("p_name"), F.lit("-"), F.col("p_partkey")).alias("name"), F.col("p_size").cast("long").alias("bytes"), (F.col("p_type") == "ECONOMY").alias("picture"))
    return packing.pack(parts, [], "name", "bytes", 4).groupBy(F.col("bin").cast("long").alias("shard")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"), F.count_if("picture").alias("pictures"))


_SHARDS = """
WITH RECURSIVE p AS (SELECT p_name || '-' || p_partkey AS name, p_size::BIGINT AS b, p_type = 'ECONOMY' AS pic FROM part),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY b DESC, lower(name), name) AS i FROM p),
r AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0]::BIGINT[] AS load, 0::BIGINT AS bin
  UNION ALL SELECT o.i, list_transform([1, 2, 3, 4], lambda k: r.load[k] + CASE WHEN k = list_position(r.load, list_min(r.load)) THEN o.b ELSE 0 END), (list_position(r.load, list_min(r.load)) - 1)::BIGINT FROM r JOIN o ON o.i = r.i + 1)
SELECT bin AS shard, CAST(sum(b) AS BIGINT) AS bytes, count(*) AS files, count(*) FILTER (pic) AS pictures FROM r JOIN o USING (i) GROUP BY bin
"""


def calibration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error, selective accuracy, macro F1 and balanced accuracy of a length rule against the quality labels."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("quality", F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("predicted"), F.least(F.lit(1.0), 0.5 + F.abs(F.col("n_chars") - 800) / 4000).alias("confidence"))
    rows = rows.withColumn("correct", F.col("quality") == F.col("predicted"))
    both = coverage.calibration_error(rows, "confidence", "correct").crossJoin(coverage.selective_accuracy(rows, "confidence", "correct", 0.7)).crossJoin(coverage.macro(coverage.class_metrics(rows, "quality", "predicted")))  # a row each
    return both.select(*[F.round(c, 6).alias(c) for c in both.columns])


_CALIBRATION = """
WITH r AS (SELECT quality AS y, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS p, least(1.0, 0.5 + abs(n_chars - 800) / 4000)::DOUBLE AS c FROM labels JOIN documents USING (doc_id)),
b AS (SELECT least(floor(c * 10), 9) AS k, count(*) AS n, abs(avg(c) - avg((y = p)::INT)) AS gap FROM r GROUP BY 1),
l AS (SELECT y, count(*) AS support, count(*) FILTER (y = p) AS hits, (SELECT count(*) FROM r AS q WHERE q.p = r.y) AS said FROM r GROUP BY y),
m AS (SELECT CASE WHEN said > 0 THEN hits::DOUBLE / said ELSE 0 END AS precision, hits::DOUBLE / support AS recall FROM l)
SELECT round((SELECT sum(n * gap) / sum(n) FROM b), 6) AS ece, round((SELECT avg((c >= 0.7)::INT) FROM r), 6) AS covered, round((SELECT avg((y = p)::INT) FROM r WHERE c >= 0.7), 6) AS accuracy,
  round((SELECT avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END) FROM m), 6) AS macro_f1, round((SELECT avg(recall) FROM m), 6) AS balanced_accuracy
"""


def top_three_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a user's last kind of event is among the three kinds that they have most."""
    events = table(spark, sf_dir, "events")
    counts = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    ranked = counts.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("by"), "event_type"))), lambda x: x["event_type"]).alias("ranked"))
    last = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"))
    out = coverage.top_recall(last.join(ranked, "user_id"), "last", "ranked")
    return out.select("label", "support", F.round("recall", 6).alias("recall"))


_TOP3 = """
WITH k AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY user_id, event_type),
l AS (SELECT user_id, arg_max(event_type, event_id) AS label FROM events GROUP BY user_id)
SELECT label, count(*) AS support, round(avg((place <= 3)::INT), 6) AS recall FROM l JOIN k ON k.user_id = l.user_id AND k.event_type = label GROUP BY label
"""


def file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files fetched again and as recovered ones: drift states, and which are accepted."""
    sha, i, half = F.sha2("text", 256), F.col("doc_id"), F.lit("00000000000000ff")
    near = F.when(i % 3 == 0, half).when(i % 3 == 1, "00000000000000f0").otherwise("ffffffffffffffff")
    state = V.drift(sha, F.when(i % 5 == 0, F.lit(None)).when(i % 5 == 1, sha).otherwise("other"), near, half, F.col("lang") != "de")
    accepted = V.recovered(sha, F.when(i % 7 == 0, sha).otherwise("other"), F.when(i % 11 == 0, "broken").otherwise(near), half)
    return table(spark, sf_dir, "documents").groupBy(state.alias("state"), accepted.alias("accepted")).agg(F.count("*").alias("n"))


_FILES = """
SELECT CASE doc_id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'stable' ELSE CASE WHEN doc_id % 3 = 0 AND lang <> 'de' THEN 're-encoded' ELSE 'drift' END END AS state,
  doc_id % 7 = 0 OR (doc_id % 11 <> 0 AND doc_id % 3 < 2) AS accepted, count(*) AS n FROM documents GROUP BY ALL
"""


def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed figures by priority and then id, ids that are missing first; a limit keeps what one looks at."""
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("parent"), F.when(F.col("c_mktsegment") == "BUILDING", "P0").otherwise("P1").alias("priority"), "c_custkey")
    return ordered.by_priority(rows, "priority", "parent", "c_custkey").limit(40)


_PRIORITY = """
SELECT CASE WHEN c_acctbal > 0 THEN c_name END AS parent, CASE WHEN c_mktsegment = 'BUILDING' THEN 'P0' ELSE 'P1' END AS priority, c_custkey FROM customer
ORDER BY priority, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, ''), c_custkey LIMIT 40
"""

QUERIES: dict[str, Entry] = {
    "acquisition_checks": (acquisition_checks, _ACQUISITION),
    "source_checks": (source_checks, _SOURCES),
    "permission_checks": (permission_checks, _PERMISSIONS),
    "transfer_checks": (transfer_checks, _TRANSFER),
    "persistence_checks": (persistence_checks, _PERSISTENCE),
    "export_checks": (export_checks, _EXPORT),
    "provenance_checks": (provenance_checks, _PROVENANCE),
    "split_implications": (split_implications, _IMPLIED),
    "reviewed_sources": (reviewed_sources, _REVIEWED),
    "content_gates": (content_gates, _CONTENT),
    "gate_violations": (gate_violations, _GATES),
    "catalogue_gates": (catalogue_gates, _gates_sql()),
    "binary_checks": (binary_checks, _BINARIES),
    "store_checks": (store_checks, _STORE),
    "release_counts": (release_counts, _RELEASE),
    "split_gate": (split_gate, _GATE),
    "coverage_audit": (coverage_audit, _COVERAGE_AUDIT),
    "global_totals": (global_totals, _TOTALS),
    "shard_totals": (shard_totals, _SHARDS),
    "calibration_metrics": (calibration_metrics, _CALIBRATION),
    "top_three_recall": (top_three_recall, _TOP3),
    "file_states": (file_states, _FILES),
    "priority_order": (priority_order, _PRIORITY),
}
