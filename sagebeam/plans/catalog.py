"""Catalogue assembly, media, policies, routing and panel queries over the test tables, which stand for catalogue rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebeam.functions import paths
from sagebeam.functions import text as T
from sagebeam.operators import adjudication, media, merging, ordered, ranking, routing, splits
from sagebeam.plans import curation
from sagebeam.plans.tables import Entry, spread, table
from sagebeam.sources import documents


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def media_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as media: languages stand for permissions and sources for review states; how many may be shown or trained on."""
    permission = F.when(F.col("lang") == "en", "permitted").when(F.col("lang") == "de", "not-permitted").otherwise("unknown")
    permission = F.when(F.col("lang") == "fr", "permitted").otherwise(permission)
    status = F.when(F.col("source") < "src12", "approved-reference").when(F.col("source") < "src16", "approved-training").otherwise("pending")
    rows = _docs(spark, sf_dir).select(media.displayable(permission, status).alias("displayable"), media.trainable(F.col("n_chars") > 500, permission).alias("trainable"))
    return rows.groupBy("displayable", "trainable").agg(F.count("*").alias("n"))


_MEDIA = """
WITH m AS (SELECT lang IN ('en', 'fr') AS permitted, source < 'src16' AS approved, n_chars > 500 AS eligible FROM documents)
SELECT permitted AND approved AS displayable, eligible AND permitted AS trainable, count(*) AS n FROM m GROUP BY ALL
"""


def kept_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as media of a profile: those that may be kept, in the form of candidates."""
    license_ = F.when(F.col("page_id") % 3 == 0, "CC BY 4.0").when(F.col("page_id") % 3 == 1, "CC BY").otherwise("CC BY-NC 4.0")
    host = F.regexp_extract("url", r"^https?://(?:[^./]+\.)(example\.[a-z]+)/", 1)
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.lit("image").alias("mediaType"), F.lit("permitted").alias("displayPermission"), F.when(F.col("page_id") % 4 == 0, "unknown").otherwise("permitted").alias("trainingPermission"),
        license_.alias("license"), F.concat(F.lit("https://"), host, F.lit("/"), F.col("page_id")).alias("url"), F.concat(F.lit("slug-"), F.col("page_id") % 5).alias("issueSlug"), F.col("url").alias("sourceUrl"),
        F.when(F.col("page_id") % 2 == 0, "").otherwise("a caption").alias("caption"), F.lit(None).cast("string").alias("alt"), F.lit("a label").alias("diagnosticLabel"),
        F.when(F.col("page_id") % 5 == 0, F.lit(None).cast("string")).otherwise("somebody").alias("creator"), F.sha2("html", 256).alias("sha256"), F.lit(None).cast("string").alias("perceptualHash"))
    out = media.kept_candidates(rows, ("example.com", "example.org"))
    return out.select("id", "issue_slug", "image_url", "source_article", "caption", "creator", "license", "intended_use", "required_fetch", "expected_sha256")


_KEPT = f"""
WITH p AS (SELECT *, regexp_extract(url, '^https?://(?:[^./]+\\.)(example\\.[a-z]+)/', 1) AS host FROM pages)
SELECT page_id AS id, 'slug-' || page_id % 5 AS issue_slug, 'https://' || host || '/' || page_id AS image_url, url AS source_article,
  CASE WHEN page_id % 2 = 0 THEN 'a label' ELSE 'a caption' END AS caption, CASE WHEN page_id % 5 = 0 THEN '{media.NO_CREATOR}' ELSE 'somebody' END AS creator,
  CASE WHEN page_id % 3 = 0 THEN 'CC BY 4.0' ELSE 'CC BY' END AS license, 'reference-only' AS intended_use, false AS required_fetch, sha256(html) AS expected_sha256
FROM p WHERE page_id % 4 <> 0 AND page_id % 3 < 2 AND host IN ('example.com', 'example.org')
"""

_RULES = (("title", "1-URGENT", {"url": "https://a", "doi": "D1"}), ("doi", "F", {"organization": "corrected"}), ("title", "2-HIGH", {"url": "https://b"}))


def source_errata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the sources of their customers, corrected by title or DOI, the first rule that holds alone."""
    entry = F.struct(F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("doi"), F.lit("https://x").alias("url"), F.lit("as told").alias("organization"))
    listed = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(entry).alias("sources"))
    rows = listed.select(F.explode(media.corrected(F.col("sources"), _RULES)).alias("s")).select("s.*")
    return rows.groupBy("title", "doi", "url", "organization").agg(F.count("*").alias("n"))


_ERRATA = """
SELECT o_orderpriority AS title, CASE WHEN o_orderpriority = '1-URGENT' THEN 'D1' ELSE o_orderstatus END AS doi,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'https://a' WHEN o_orderstatus = 'F' THEN 'https://x' WHEN o_orderpriority = '2-HIGH' THEN 'https://b' ELSE 'https://x' END AS url,
  CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderstatus = 'F' THEN 'corrected' ELSE 'as told' END AS organization, count(*) AS n FROM orders GROUP BY ALL
"""


def record_errata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one language get another category and summary, and their warnings that hold a phrase another text."""
    rows = _docs(spark, sf_dir).select("doc_id", F.col("lang").alias("slug"), F.col("source").alias("category"), F.lit("old").alias("summary"), F.split("text", r"\. ").alias("warnings"))
    out = media.corrected_records(rows, "slug", {"fr": {"category": "corrected", "summary": "new"}}, {"fr": ("es", "a warning")})
    return out.select("doc_id", "category", "summary", F.array_join("warnings", "|").alias("warnings"))


_RECORD = """
WITH d AS (SELECT doc_id, lang, source, string_split(text, '. ') AS w FROM documents)
SELECT doc_id, CASE WHEN lang = 'fr' THEN 'corrected' ELSE source END AS category, CASE WHEN lang = 'fr' THEN 'new' ELSE 'old' END AS summary,
  array_to_string(CASE WHEN lang = 'fr' THEN list_transform(w, lambda x: CASE WHEN contains(x, 'es') THEN 'a warning' ELSE x END) ELSE w END, '|') AS warnings FROM d
"""


def profile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as profiles with their orders as sources and urgent ones as media; those with a debt are the core."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("o_orderkey").alias("sources"), F.collect_list(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey"))).alias("media"))
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), "c_acctbal").join(orders, "id", "left")
    return media.index_rows(profiles.drop("c_acctbal"), profiles.where("c_acctbal < 0"), "id")


_INDEX = """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS category, count(o_orderkey) AS source_count, count(*) FILTER (o_orderpriority = '1-URGENT') AS media_count,
  CASE WHEN c_acctbal < 0 THEN 'core' ELSE 'supplemental' END AS source_layer, 'diagnostic-profile' AS record_type, 'data/profiles/' || c_custkey || '.json' AS path
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment, c_acctbal
"""


def overlay_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the segment and balance of a patch by nation laid over them, where the patch has them."""
    patches = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_regionkey") == 1, F.col("n_name")).alias("c_mktsegment"), F.when(F.col("n_regionkey") == 2, 0.0).alias("c_acctbal"), F.col("n_name").alias("controlled"))
    return merging.overlay(table(spark, sf_dir, "customer"), patches, "c_nationkey")


_OVERLAY = """
SELECT c_custkey, c_name, c_nationkey, CASE WHEN n_regionkey = 2 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN n_regionkey = 1 THEN n_name ELSE c_mktsegment END AS c_mktsegment, n_name AS controlled
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
"""


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders as changes of their state: the last one wins, and takes the customer's place."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("state"), F.col("c_custkey").alias("pos"))
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("state"), (F.col("o_orderkey") + 1_000_000_000).alias("pos"))
    return merging.upsert(base, changes, "id", "pos")


_UPSERT = """
SELECT c_custkey AS id, coalesce(arg_max(o_orderpriority, o_orderkey), c_mktsegment) AS state, c_custkey AS pos FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment
"""


def union_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as three catalogues in this order, with their place in the union and in their own one."""
    frames = [table(spark, sf_dir, t).select(F.col(n).alias("name"), F.col(k).alias("catalog_pos")) for t, n, k in (("region", "r_name", "r_regionkey"), ("nation", "n_name", "n_nationkey"), ("supplier", "s_name", "s_suppkey"))]
    return merging.union_in_order(frames).select("name", F.col("catalog_pos.frame").cast("long").alias("frame"), F.col("catalog_pos.pos").alias("pos"))


_UNION = """
SELECT r_name AS name, 0::BIGINT AS frame, r_regionkey::BIGINT AS pos FROM region UNION ALL SELECT n_name, 1, n_nationkey FROM nation UNION ALL SELECT s_name, 2, s_suppkey FROM supplier
"""


def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of orders and of lines as multisets of (status, year): what one side has more often."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), F.year("l_shipdate").alias("year"))
    return merging.same_rows(orders, lines).groupBy("side", "status", "year").agg(F.count("*").alias("n"))


_MULTISET = """
WITH o AS (SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY ALL),
l AS (SELECT l_linestatus AS status, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n FROM lineitem GROUP BY ALL),
j AS (SELECT coalesce(o.status, l.status) AS status, coalesce(o.year, l.year) AS year, coalesce(o.n, 0) - coalesce(l.n, 0) AS d FROM o FULL JOIN l ON o.status = l.status AND o.year = l.year)
SELECT CASE WHEN d > 0 THEN 'left' ELSE 'right' END AS side, status, year, abs(d) AS n FROM j WHERE d <> 0
"""


def deep_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested records: the roles in order against those of a copy in which long turns have lost their role."""
    turns = table(spark, sf_dir, "conversations")
    listed = lambda rows: rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    changed = turns.withColumn("role", F.when(F.length("text") < 400, F.col("role")))
    return merging.deep_diff(listed(turns), listed(changed.where("turn < 9")), "conv_id")


_DEEP = """
SELECT conv_id, CASE WHEN count(*) FILTER (turn < 9) = 0 THEN 'missing' WHEN max(turn) >= 9 OR max(length(text)) FILTER (turn < 9) >= 400 THEN 'changed' ELSE 'same' END AS state FROM conversations GROUP BY conv_id
"""


def keep_last_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' shipped value from filled orders, else what an earlier snapshot of all orders had."""
    value = lambda rows: rows.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    orders = table(spark, sf_dir, "orders")
    new = table(spark, sf_dir, "customer").select("c_custkey").join(value(orders.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")), "c_custkey", "left")
    return merging.keep_last_good(new, value(orders), "c_custkey", ["value"])


_LAST_GOOD = """
WITH n AS (SELECT o_custkey, round(sum(o_totalprice) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'), 2) AS new, round(sum(o_totalprice), 2) AS old FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(new, old) AS value, new IS NULL AND old IS NOT NULL AS preserved FROM customer LEFT JOIN n ON o_custkey = c_custkey
"""


def best_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tries to fetch something for a user: the first good one, the largest good one, and the errors in order."""
    tries = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("url"), (F.col("event_type") != "error").alias("valid"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"), "value")
    first, largest = merging.best_attempt(tries, "user_id", "event_id"), merging.best_attempt(tries, "user_id", "event_id", "value")
    return first.select("user_id", F.col("url").alias("first"), F.array_join("errors", ";").alias("errors")).join(largest.select("user_id", F.col("url").alias("largest")), "user_id")


_ATTEMPTS = """
SELECT user_id, arg_min(event_type, event_id) FILTER (event_type <> 'error') AS first, arg_max(event_type, (value, -event_id)) FILTER (event_type <> 'error') AS largest,
  coalesce(string_agg(props, ';' ORDER BY event_id) FILTER (event_type = 'error'), '') AS errors FROM events GROUP BY user_id
"""


def unlike_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose documents are not alike in language and source."""
    return merging.repeated_unlike(_docs(spark, sf_dir).select(F.sha2("text", 256).alias("digest"), "lang", "source"), "digest")


_UNLIKE = "SELECT sha256(text) AS digest, count(DISTINCT (lang, source)) AS versions FROM documents GROUP BY 1 HAVING count(DISTINCT (lang, source)) > 1"

_POLICIES = [("P-OWN", ["FURNITURE"], 0.9, "true", 1), ("P-SECOND", ["FURNITURE", "BUILDING"], 0.5, "false", 2), ("P-SLUG", [], 0.7, "true", 3), ("P-DEFAULT", [], 0.8, "false", 4)]


def policy_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' policies: by an id of their own, by their segment, by their nation, by default."""
    policies = spark.createDataFrame([(*p[:4], ["a check"], p[4]) for p in _POLICIES], "policy_id string, canonical_ids array<string>, cap double, can_confirm string, required array<string>, ord int")
    slugs = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("slug"), F.lit("P-SLUG").alias("slug_policy"))
    records = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, "P-OWN").alias("response_policy_id"), F.col("c_mktsegment").alias("canonical_id"), F.col("c_nationkey").alias("slug"))
    out = ranking.resolve_policy(records, policies, slugs, "P-DEFAULT")
    return out.select("c_custkey", F.col("resolved_policy_id").alias("policy"), F.col("cap_policy").alias("cap"), "can_confirm")


_CASCADE = """
WITH p AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'P-OWN' WHEN c_mktsegment = 'FURNITURE' THEN 'P-OWN' WHEN c_mktsegment = 'BUILDING' THEN 'P-SECOND' WHEN n_regionkey = 0 THEN 'P-SLUG' ELSE 'P-DEFAULT' END AS policy
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey)
SELECT *, CASE policy WHEN 'P-OWN' THEN 0.9 WHEN 'P-SECOND' THEN 0.5 WHEN 'P-SLUG' THEN 0.7 ELSE 0.8 END::DOUBLE AS cap, CASE WHEN policy IN ('P-OWN', 'P-SLUG') THEN 'true' ELSE 'false' END AS can_confirm FROM p
"""


def adjudicate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as cases: event types are candidates, their mean values scores, errors checks; policies, evidence and missing views included."""
    events = table(spark, sf_dir, "events")
    scored = events.groupBy("user_id", "event_type").agg(F.round(F.avg(F.least(F.abs("value") / 100, F.lit(1.0))), 10).alias("score"), F.count("*").alias("n"))
    candidate = F.struct(F.col("event_type").alias("canonical_id"), F.upper("event_type").alias("canonical_label"), F.col("score").alias("calibrated_score"), F.array(F.lit("a reason")).alias("reasons"))
    check = F.struct(F.lit(False).alias("unresolved"), F.array(F.concat(F.lit("view of "), "event_type"), F.lit("a view")).alias("missing_evidence"), F.when(F.col("n") > 20, F.array(F.lit("too many"))).otherwise(F.expr("cast(array() as array<string>)")).alias("contradictions"))
    cases = scored.groupBy(F.col("user_id").alias("case_id")).agg(
        F.array_sort(F.collect_list(candidate)).alias("candidates"), F.array_sort(F.collect_list(check), lambda a, b: F.when(a["missing_evidence"][0] < b["missing_evidence"][0], -1).otherwise(1)).alias("checks"))
    cases = cases.withColumn("open_set_unknown_score", (F.col("case_id") % 10) / 10).withColumn("pass2_evidence_ids", F.array(F.lit("E")))
    policies = spark.createDataFrame([("P-BUY", ["purchase"], 0.4, "false", 1), ("P-ANY", [], 0.7, "true", 2)], "policy_id string, canonical_ids array<string>, cap double, can_confirm string, ord int")
    evidence = events.groupBy(F.col("event_type").alias("canonical_id")).agg(F.array(F.count("*")).alias("evidence"))
    out = adjudication.adjudicate(cases, policies, evidence, "P-ANY")
    return out.select(
        "case_id", F.col("primary.canonical_id").alias("primary_id"), F.array_join(F.transform("alternatives", lambda c: c["canonical_id"]), "|").alias("alternatives"), "final_confidence", "provisional",
        F.col("response_policy_id").alias("policy"), F.array_join("requested_evidence", "|").alias("requested"), F.col("controlled_evidence")[0].alias("evidence"))


_CASES = """
WITH scored AS (SELECT user_id, event_type, round(avg(least(abs(value) / 100, 1.0)), 10) AS score, count(*) AS n FROM events GROUP BY user_id, event_type),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS place FROM scored),
tops AS (
  SELECT user_id, max(event_type) FILTER (place = 1) AS primary_id, max(score) FILTER (place = 1) AS top, coalesce(string_agg(event_type, '|' ORDER BY place) FILTER (place BETWEEN 2 AND 4), '') AS alternatives,
    max(n) > 20 OR (user_id % 10) / 10.0 >= 0.55 AS doubtful, list('view of ' || event_type ORDER BY event_type) AS views
  FROM placed GROUP BY user_id),
totals AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT user_id AS case_id, primary_id, alternatives, least(top, CASE primary_id WHEN 'purchase' THEN 0.4 ELSE 0.7 END::DOUBLE, CASE WHEN doubtful THEN 0.59 ELSE 9 END::DOUBLE) AS final_confidence,
  doubtful OR primary_id = 'purchase' AS provisional, CASE primary_id WHEN 'purchase' THEN 'P-BUY' ELSE 'P-ANY' END AS policy, array_to_string(list_concat([views[1], 'a view'], views[2:]), '|') AS requested, totals.n AS evidence
FROM tops JOIN totals ON event_type = primary_id
"""


def _has(text: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def nine_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as picture records: their lane by host fields and words, and that none of the own host is sent away."""
    source = F.col("source")
    host = F.when(source == "src1", "Cross-Crop figure").when(source == "src2", "organism-only").when(source == "src3", "cannabis").otherwise("")
    species = F.when(source == "src4", "Hemp crop").when(source == "src5", "tomato").otherwise("")
    rows = spread(_docs(spark, sf_dir)).select("doc_id", host.alias("host_context"), species.alias("host_species"), T.lineage(F.col("text"), F.when(F.col("lang") == "de", F.lit("Hemp")), F.col("source")).alias("blob"))
    rows = rows.withColumn("blob", F.when(F.col("host_context") == "Cross-Crop figure", "a figure of another crop").otherwise(F.col("blob")))
    routed = routing.routed(rows, "blob", "host_context", "host_species")
    checked = routing.assert_kept_home(routed, "blob")
    lanes = spark.createDataFrame([(k,) for k in (*routing.LANES, routing.TRANSFER, routing.GATED)], "lane string")
    return routing.lane_counts(checked, lanes)


_NINE = f"""
WITH d AS (SELECT CASE source WHEN 'src1' THEN 'x' WHEN 'src2' THEN 'o' WHEN 'src3' THEN 'h' WHEN 'src4' THEN 's' WHEN 'src5' THEN 's' ELSE '' END AS h, lower(concat_ws(' ', text, CASE WHEN lang = 'de' THEN 'Hemp' END, source)) AS t FROM documents),
r AS (SELECT CASE WHEN h = 'x' THEN '{routing.TRANSFER}' WHEN h = 'o' THEN '{routing.GATED}' WHEN NOT {_has("t", routing.HOST_TERMS)} THEN CASE WHEN h <> '' THEN '{routing.TRANSFER}' ELSE '{routing.GATED}' END
  {" ".join(f"WHEN {_has('t', terms)} THEN '{lane}'" for lane, terms in routing.LANES.items())} ELSE '{routing.GATED}' END AS lane FROM d)
SELECT v.lane, count(r.lane) AS n FROM (VALUES {", ".join(f"('{k}')" for k in (*routing.LANES, routing.TRANSFER, routing.GATED))}) AS v(lane) LEFT JOIN r ON r.lane = v.lane GROUP BY v.lane
"""


def _panels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, sf_dir)
    panels = docs.select(
        "doc_id", F.col("source").alias("parent_id"), F.when(F.col("lang") == "de", "Hemp leaf").otherwise("leaf").alias("host"), F.when(F.col("lang") == "fr", "Lab-confirmed").otherwise("seen").alias("confirmation"),
        F.when(F.col("n_chars") > 3000, "A").alias("embedded_panel_label"), F.when(F.col("lang") == "es", "x-reference").otherwise("x").alias("issue_slug"), (F.col("n_chars") < 300).alias("reference_only_class"),
        F.when(F.col("n_chars") % 7 != 0, F.col("source")).alias("source_group_id"), F.sha2("text", 256).alias("sha256"), F.when(F.col("n_chars") % 5 != 0, "h").otherwise("").alias("perceptual_hash"))
    parents = docs.select(F.col("source").alias("id")).distinct().select(
        "id", F.lit("").alias("host_species"), F.when(F.col("id") < "src14", "cannabis").otherwise("").alias("host_context"), F.lit("c").alias("caption"), F.lit("a").alias("source_article"),
        F.when(F.col("id") < "src12", "molecular test").otherwise("").alias("confirmation"), F.when(F.col("id") == "src3", "CC BY-NC").otherwise("CC BY 4.0").alias("license"), F.when(F.col("id") == "src4", F.lit(None).cast("string")).otherwise("reference-only").alias("intended_use"))
    return panels, parents


def panel_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as panels of their sources: how often each blocker of the training audit holds, and how many panels have none."""
    audited = routing.audit_panels(*_panels(spark, sf_dir))
    return audited.select(F.explode(F.when(F.col("candidate"), F.array(F.lit("none"))).otherwise(F.col("blockers"))).alias("blocker")).groupBy("blocker").agg(F.count("*").alias("n"))


_AUDIT = """
WITH p AS (SELECT *, lang = 'de' OR source < 'src14' AS host, lang = 'fr' OR source < 'src12' AS strong FROM documents),
b AS (
  SELECT doc_id, 'non_cannabis_or_unresolved_host' AS blocker FROM p WHERE NOT host UNION ALL SELECT doc_id, 'license_not_training_compatible' FROM p WHERE source = 'src3'
  UNION ALL SELECT doc_id, 'unexpected_parent_use_state' FROM p WHERE source = 'src4' UNION ALL SELECT doc_id, 'confirmation_not_strong_enough_for_causal_seed' FROM p WHERE NOT strong
  UNION ALL SELECT doc_id, 'embedded_panel_label_shortcut_risk' FROM p WHERE n_chars > 3000 UNION ALL SELECT doc_id, 'reference_only_or_unmaterialized_canonical_class' FROM p WHERE lang = 'es' OR n_chars < 300
  UNION ALL SELECT doc_id, 'missing_source_group' FROM p WHERE n_chars % 7 = 0 UNION ALL SELECT doc_id, 'missing_hashes' FROM p WHERE n_chars % 5 = 0)
SELECT blocker, count(*) AS n FROM b GROUP BY blocker UNION ALL SELECT 'none', count(*) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM b)
"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of the archive of plant pictures."""
    i, name = F.col("doc_id"), F.concat(F.lit("img"), F.col("doc_id"), F.lit(".jpg"))
    plant = F.concat(F.when(F.col("lang") == "de", "c").otherwise("C"), (i % 7).cast("string"))
    path = (
        F.when(F.col("lang") == "en", F.concat(F.lit("Hemp_growth/"), plant, F.lit("/"), name)).when(F.col("source") < "src12", F.concat(F.lit("Hemp_water_stress/train/"), F.col("source"), F.lit("/ryb_"), plant, F.lit("_2024.jpg")))
        .when(F.col("source") < "src16", F.concat(F.lit("Hemp_water_stress/test/dry/"), name)).when(F.col("source") == "src3", F.lit("weights/yolo11x-cls.pt")).otherwise(F.concat(F.lit("README/"), plant, F.lit(".md"))))
    return _docs(spark, sf_dir).select("doc_id", path.alias("path"))


_TREE = """
WITH f AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'c' ELSE 'C' END || doc_id % 7 AS pl, 'img' || doc_id || '.jpg' AS nm, * FROM documents),
t AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'Hemp_growth/' || pl || '/' || nm WHEN source < 'src12' THEN 'Hemp_water_stress/train/' || source || '/ryb_' || pl || '_2024.jpg'
  WHEN source < 'src16' THEN 'Hemp_water_stress/test/dry/' || nm WHEN source = 'src3' THEN 'weights/yolo11x-cls.pt' ELSE 'README/' || pl || '.md' END AS path FROM f),
parts AS (SELECT *, string_split(path, '/') AS p FROM t),
named AS (SELECT *, regexp_extract(p[-1], '(?i)(?:^|_)(C[1-5])(?:_|\\.)', 1) AS own FROM parts)
"""


def path_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plant, group, class and split of files by their paths."""
    rows = _tree(spark, sf_dir)
    return rows.select("doc_id", paths.plant(F.col("path")).alias("plant"), paths.group_id(paths.plant(F.col("path"))).alias("plant_group"), paths.source_class(F.col("path")).alias("source_class"), paths.source_split(F.col("path")).alias("source_split"))


_PATHS = _TREE + """,
q AS (SELECT *, CASE WHEN own <> '' THEN upper(own) WHEN p[1] = 'Hemp_growth' AND regexp_full_match(p[2], '(?i)C[1-5]') THEN upper(p[2]) ELSE 'UNKNOWN' END AS plant FROM named)
SELECT doc_id, plant, 'DS090-' || plant AS plant_group, CASE WHEN p[1] = 'Hemp_growth' THEN 'temporal-growth' WHEN len(p) >= 4 AND p[1] = 'Hemp_water_stress' AND p[2] IN ('train', 'test') THEN p[3] ELSE '' END AS source_class,
  CASE WHEN p[1] = 'Hemp_water_stress' AND p[2] = 'train' THEN 'publisher-train' WHEN p[1] = 'Hemp_water_stress' AND p[2] = 'test' THEN 'publisher-test' ELSE 'growth-series' END AS source_split FROM q
"""


def inventory_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, class, role and eligibility of files in the inventory."""
    return _tree(spark, sf_dir).select("doc_id", paths.inventory(F.col("path")).alias("i")).select("doc_id", F.col("i.group").alias("source_group"), "i.source_class", "i.role", "i.eligible", "i.notes")


_ROLES = _TREE + f"""
SELECT doc_id,
  CASE WHEN p[1] = 'weights' THEN '{paths.MODEL_GROUP}' WHEN p[1] = 'Hemp_growth' THEN 'DS090-' || p[2] WHEN p[1] = 'Hemp_water_stress' THEN 'DS090-' || CASE WHEN p[-1] LIKE 'ryb_C_%' THEN string_split(p[-1], '_')[2] ELSE 'unknown' END ELSE '' END AS source_group,
  CASE p[1] WHEN 'weights' THEN 'model' WHEN 'Hemp_growth' THEN 'temporal-growth' WHEN 'Hemp_water_stress' THEN p[3] ELSE '' END AS source_class,
  CASE p[1] WHEN 'weights' THEN '{paths.MODEL_ROLE}' ELSE '{paths.SOURCE_ROLE}' END AS role, p[1] <> 'weights' AS eligible,
  CASE p[1] WHEN 'weights' THEN '{paths.NO_TRUTH}' WHEN 'Hemp_growth' THEN '{paths.KEEP_TOGETHER}' WHEN 'Hemp_water_stress' THEN '{paths.REGROUP}' ELSE '' END AS notes FROM parts
"""


def slot_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uploads to the slots of users: the newest of each slot, four of one kind."""
    return ordered.keep_slots(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", {"click": 4}).select("user_id", "event_type", "event_id")


_SLOTS = "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) <= CASE event_type WHEN 'click' THEN 4 ELSE 1 END"


def evidence_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which slots users have evidence in."""
    names = ("click", "error", "purchase")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.bool_or(F.col("event_type") == n).alias(f"has_{n}") for n in names])


_EVIDENCE_SLOTS = "SELECT user_id, bool_or(event_type = 'click') AS has_click, bool_or(event_type = 'error') AS has_error, bool_or(event_type = 'purchase') AS has_purchase FROM events GROUP BY user_id"


def group_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source, by language and by length, as nested counters."""
    rows = _docs(spark, sf_dir).withColumn("long", F.when(F.col("n_chars") > 1000, "long").otherwise("short"))
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return splits.group_profile(rows, "source", "long", "lang").select("source", "n", shown("by_long").alias("by_long"), shown("by_lang").alias("by_lang"))


_GROUPS = """
WITH d AS (SELECT source, lang, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS k FROM documents),
a AS (SELECT source, string_agg(k || '=' || n, ';' ORDER BY k) AS by_long FROM (SELECT source, k, count(*) AS n FROM d GROUP BY ALL) AS x GROUP BY source),
b AS (SELECT source, string_agg(lang || '=' || n, ';' ORDER BY lang) AS by_lang FROM (SELECT source, lang, count(*) AS n FROM d GROUP BY ALL) AS x GROUP BY source)
SELECT source, n, by_long, by_lang FROM (SELECT source, count(*) AS n FROM d GROUP BY source) AS c JOIN a USING (source) JOIN b USING (source)
"""


def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources dealt to the three parts of the chosen split: one validates, one tests, the others train."""
    chosen = splits.choose_split(_docs(spark, sf_dir), "source", "lang")
    part = F.when(F.col("source") == F.col("validation_group"), "validation").when(F.col("source") == F.col("test_group"), "test").otherwise("train")
    groups = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return groups.crossJoin(chosen).groupBy(part.alias("part")).agg(F.count("*").alias("groups"), F.sum("n").alias("n"))  # chosen is one row


_PARTS = f"""
WITH chosen AS ({curation.SPLIT_SQL}),
g AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT CASE WHEN source = validation_group THEN 'validation' WHEN source = test_group THEN 'test' ELSE 'train' END AS part, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n FROM g, chosen GROUP BY ALL
"""


def members_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as members of the archives of their brands: for each wanted name the member of that name, else the largest that holds its stem."""
    members = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.concat(F.lit("dir/"), F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey"), F.lit(".jpg")).alias("member"), F.col("p_size").cast("long").alias("bytes"))
    wanted = members.select("path").distinct().select("path", F.explode(F.array(F.lit("cold_widget_0.jpg"), F.lit("widget.png"), F.lit("gizmo.png"))).alias("name"))
    return documents.pick_member(members, wanted)


_PICKED = """
WITH m AS (SELECT p_brand AS path, 'dir/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.jpg' AS member, CAST(p_size AS BIGINT) AS bytes FROM part),
w AS (SELECT DISTINCT path, unnest(['cold_widget_0.jpg', 'widget.png', 'gizmo.png']) AS name FROM m),
j AS (SELECT path, name, member, bytes, lower(regexp_extract(member, '([^/]+)$', 1)) = name AS exact FROM m JOIN w USING (path) WHERE lower(regexp_extract(member, '([^/]+)$', 1)) = name OR contains(lower(regexp_extract(member, '([^/]+)$', 1)), regexp_replace(name, '\\.[^.]+$', '')))
SELECT path, name, member, bytes FROM j QUALIFY row_number() OVER (PARTITION BY path, name ORDER BY exact DESC, bytes DESC, member DESC) = 1
"""

QUERIES: dict[str, Entry] = {
    "media_states": (media_states, _MEDIA),
    "kept_candidates": (kept_candidates, _KEPT),
    "source_errata": (source_errata, _ERRATA),
    "record_errata": (record_errata, _RECORD),
    "profile_index": (profile_index, _INDEX),
    "overlay_patch": (overlay_patch, _OVERLAY),
    "upsert_latest": (upsert_latest, _UPSERT),
    "union_order": (union_order, _UNION),
    "multiset_diff": (multiset_diff, _MULTISET),
    "deep_equality": (deep_equality, _DEEP),
    "keep_last_good": (keep_last_good, _LAST_GOOD),
    "best_attempts": (best_attempts, _ATTEMPTS),
    "unlike_repeats": (unlike_repeats, _UNLIKE),
    "policy_cascade": (policy_cascade, _CASCADE),
    "adjudicate_cases": (adjudicate_cases, _CASES),
    "nine_lanes": (nine_lanes, _NINE),
    "panel_audit": (panel_audit, _AUDIT),
    "path_fields": (path_fields, _PATHS),
    "inventory_roles": (inventory_roles, _ROLES),
    "slot_limits": (slot_limits, _SLOTS),
    "evidence_slots": (evidence_slots, _EVIDENCE_SLOTS),
    "group_counters": (group_counters, _GROUPS),
    "split_parts": (split_parts, _PARTS),
    "members_picked": (members_picked, _PICKED),
}
