"""Merging, deduplication, split and routing queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebeam.functions import text as T
from sagebeam.operators import dedup, merging, metric_index, routing, splits
from sagebeam.operators.shared import bounded_batches, scratch, stored
from sagebeam.plans.tables import Entry, spread, table


def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents keyed by their text: keys with different languages or sources."""
    docs = table(spark, sf_dir, "documents").withColumn("key", T.source_key(F.lit(""), F.sha2("text", 256), F.lit(None).cast("string"), F.lit(None).cast("string")))
    return merging.conflicts(docs, ["key"], ["lang", "source"]).select("key", "field", F.col("versions").cast("long").alias("versions"))


_CONFLICTS = """
WITH c AS (SELECT sha256(text) AS key, count(DISTINCT lang) AS lang, count(DISTINCT source) AS source FROM documents GROUP BY 1)
SELECT key, 'lang' AS field, lang AS versions FROM c WHERE lang > 1 UNION ALL SELECT key, 'source', source FROM c WHERE source > 1
"""


def merge_last_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer: the last non-empty priority and status, the latest date and the priorities in order."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"),
        F.col("o_orderkey").alias("highest"), F.array("o_orderpriority").alias("priorities"))
    out = merging.merge_keyed(orders, "o_custkey", "at", latest=["status", "priority"], greatest=["highest"], lists=["priorities"])
    return out.select("o_custkey", "status", "priority", "highest", F.array_join("priorities", "|").alias("priorities"))


_LAST = """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, nullif(o_orderstatus, 'P') AS s, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
firsts AS (SELECT o_custkey, p, min(i) AS i FROM o GROUP BY o_custkey, p)
SELECT o_custkey, arg_max(s, i) FILTER (s IS NOT NULL) AS status, arg_max(p, i) AS priority, max(o_orderkey) AS highest,
  (SELECT string_agg(p, '|' ORDER BY i) FROM firsts AS f WHERE f.o_custkey = o.o_custkey) AS priorities
FROM o GROUP BY o_custkey
"""


def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents"), "text", "doc_id")


_EXACT = "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1"


def exact_cross_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.cross_class(table(spark, sf_dir, "documents"), "text", "source")


_CROSS = "SELECT sha256(text) AS digest, count(*) AS n, count(DISTINCT source) AS labels FROM documents GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT source) > 1"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64-bit difference hash of 72 slices of each whole text, a slice's value the sum of its code points."""
    return spread(table(bounded_batches(spark), sf_dir, "documents")).select("doc_id", "source", dedup.text_dhash(F.col("text")).alias("bits"))


_HASHED = """
WITH RECURSIVE sized AS MATERIALIZED (SELECT doc_id, length(text) AS n, string_split(text, '') AS chars FROM documents WHERE text IS NOT NULL),
letters AS (SELECT doc_id, n, unnest(chars) AS c, unnest(range(0, len(chars))) AS i FROM sized WHERE n > 0),
sums AS MATERIALIZED (SELECT doc_id, i * 72 // n AS k, sum(unicode(c)) AS v FROM letters GROUP BY 1, 2),
px AS MATERIALIZED (SELECT s.doc_id, t.k, coalesce(v, 0) AS v FROM sized AS s CROSS JOIN range(0, 72) AS t(k) LEFT JOIN sums ON sums.doc_id = s.doc_id AND sums.k = t.k),
bits AS (SELECT x.doc_id, x.k, CASE WHEN x.v > y.v THEN '1' ELSE '0' END AS bit FROM px AS x JOIN px AS y ON x.doc_id = y.doc_id AND y.k = x.k + 1 WHERE x.k % 9 < 8),
words AS MATERIALIZED (SELECT doc_id, string_agg(bit, '' ORDER BY k)::BIT AS word FROM bits GROUP BY doc_id),
edges AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM words AS a JOIN words AS b ON a.doc_id < b.doc_id AND bit_count(xor(a.word, b.word)) <= 4)
"""


def near_dup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different words at most four bits apart, by the words' smallest documents."""
    _, classes = dedup.hamming_classes(_hashed(spark, sf_dir), "doc_id", "bits")
    edges = dedup.hamming_edges(classes)
    x, y = classes.select(F.col("word").alias("a"), F.col("first").alias("fa")), classes.select(F.col("word").alias("b"), F.col("first").alias("fb"))
    named = edges.join(x, "a").join(y, "b")
    return named.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"), F.col("distance").cast("long").alias("distance"))


_EDGES = _HASHED + """,
firsts AS (SELECT word, min(doc_id) AS f FROM words GROUP BY word)
SELECT least(x.f, y.f) AS a, greatest(x.f, y.f) AS b, CAST(bit_count(xor(x.word, y.word)) AS BIGINT) AS distance
FROM firsts AS x JOIN firsts AS y ON x.word < y.word AND bit_count(xor(x.word, y.word)) <= 4
"""


def near_dup_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label against a stored index of those with one: words at most four bits apart, by their smallest documents."""
    hashed, labels = stored(_hashed(spark, sf_dir), "near-hashed"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    old, new = (hashed.join(labels, "doc_id", how).where("bits is not null").groupBy(F.col("bits").alias("word")).agg(F.min("doc_id").alias("first")) for how in ("left_semi", "left_anti"))
    path = scratch(spark, "near-index")
    metric_index.build(old, path)
    found = metric_index.probe(new, path)
    named = found.join(new.select(F.col("word").alias("new"), F.col("first").alias("new_doc")), "new").join(old.select(F.col("word").alias("old"), F.col("first").alias("old_doc")), "old")
    return named.select("new_doc", "old_doc", "distance")


_PROBE = _HASHED + """,
old AS (SELECT word, min(doc_id) AS f FROM words WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY word),
new AS (SELECT word, min(doc_id) AS f FROM words WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY word)
SELECT new.f AS new_doc, old.f AS old_doc, CAST(bit_count(xor(new.word, old.word)) AS BIGINT) AS distance FROM new JOIN old ON bit_count(xor(new.word, old.word)) <= 4
"""


def near_dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.near_groups(_hashed(spark, sf_dir), "doc_id", "bits")
    return out.select(F.col("member").alias("doc_id"), F.col("group").alias("group_id"), F.col("size").cast("long").alias("size"))


_COMPONENTS = _HASHED + """,
links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS doc_id, a AS seen FROM links UNION SELECT r.doc_id, b FROM reach AS r JOIN links ON r.seen = links.a),
groups AS (SELECT doc_id, min(seen) AS group_id FROM reach GROUP BY doc_id)
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS size FROM groups
"""


def near_dup_cross_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups whose members stand under more than one source."""
    found = dedup.near_groups(_hashed(spark, sf_dir), "doc_id", "bits")
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("member"), "source")
    return found.join(sources, "member").groupBy(F.col("group").alias("group_id")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources")).where("sources > 1")


_CROSS_GROUP = _COMPONENTS.replace("SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS size FROM groups", "SELECT group_id, count(*) AS n, count(DISTINCT source) AS sources FROM groups JOIN documents USING (doc_id) GROUP BY group_id HAVING count(DISTINCT source) > 1")


def near_dup_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents at most four bits apart, and those of two sources."""
    return dedup.edge_counts(_hashed(spark, sf_dir), "doc_id", "bits", "source")


_EDGE_COUNTS = _HASHED + """
SELECT count(*) AS edges, count(*) FILTER (x.source IS DISTINCT FROM y.source) AS cross_edges FROM edges JOIN documents AS x ON x.doc_id = a JOIN documents AS y ON y.doc_id = b
"""


def exact_dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of every group of equal texts."""
    return dedup.members_of(table(spark, sf_dir, "documents"), "text", "doc_id").select("digest", "n", F.col("member").alias("doc_id"))


_MEMBERS = "SELECT sha256(text) AS digest, count(*) OVER (PARTITION BY text) AS n, doc_id FROM documents QUALIFY n > 1"


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with documents in both of two pseudo splits."""
    docs = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 7 == 0, "test").when(F.col("doc_id") % 7 == 1, "validation").otherwise("train"))
    return splits.leakage(docs, "source", "split", "train", "test")


_LEAKAGE = """
SELECT source, count(*) FILTER (doc_id % 7 >= 2) AS n_first, count(*) FILTER (doc_id % 7 = 0) AS n_second
FROM documents GROUP BY source HAVING count(*) FILTER (doc_id % 7 >= 2) > 0 AND count(*) FILTER (doc_id % 7 = 0) > 0
"""


def choose_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.choose_split(table(spark, sf_dir, "documents"), "source", "lang")


SPLIT_SQL = """
WITH c AS (SELECT source AS g, lang AS k, count(*)::DOUBLE AS n FROM documents GROUP BY 1, 2),
k AS (SELECT k, sum(n) AS a FROM c GROUP BY k), t AS (SELECT sum(n) AS t FROM c),
f AS (SELECT g.g, k.k, k.a, t.t, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.g) AS s
  FROM (SELECT DISTINCT g FROM c) AS g CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.g = g.g AND c.k = k.k),
p AS (
  SELECT v.g AS validation_group, e.g AS test_group,
    sum(abs((v.a - v.n - e.n) / (v.t - v.s - e.s) - v.a / v.t)) + 0.5 * abs(max((v.t - v.s - e.s) / v.t) - 0.6)
    + sum(abs(v.n / v.s - v.a / v.t)) + 0.5 * abs(max(v.s / v.t) - 0.2) + sum(abs(e.n / e.s - v.a / v.t)) + 0.5 * abs(max(e.s / v.t) - 0.2) AS score
  FROM f AS v JOIN f AS e ON v.k = e.k AND v.g <> e.g GROUP BY 1, 2)
SELECT validation_group, test_group, round(score, 6) AS score FROM p
ORDER BY round(score, 6), least(validation_group, test_group) DESC, greatest(validation_group, test_group) DESC, validation_group LIMIT 1
"""


def admission_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each admission rule blocks, and how many none does."""
    rows = _admission(spark, sf_dir)
    named = rows.select(F.explode(F.when(F.size("blockers") > 0, F.col("blockers")).otherwise(F.array(F.lit("none")))).alias("blocker"))
    return named.groupBy("blocker").agg(F.count("*").alias("n"))


def _admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rules = [(F.col("quality").isNull(), "unlabelled"), (F.col("quality") == 0, "low_quality"), (F.col("toxic") == 1, "toxic"), (F.col("n_chars") < 200, "too_short"), (F.col("n_chars") > 10_000, "too_long")]
    return rows.withColumn("blockers", routing.blockers(rules))


_ADMISSION = """
WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)),
b AS (
  SELECT doc_id, 'unlabelled' AS blocker FROM d WHERE quality IS NULL UNION ALL SELECT doc_id, 'low_quality' FROM d WHERE quality = 0
  UNION ALL SELECT doc_id, 'toxic' FROM d WHERE toxic = 1 UNION ALL SELECT doc_id, 'too_short' FROM d WHERE n_chars < 200 UNION ALL SELECT doc_id, 'too_long' FROM d WHERE n_chars > 10000)
"""
_BLOCKERS = _ADMISSION + """
SELECT blocker, count(*) AS n FROM b GROUP BY blocker UNION ALL SELECT 'none', count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM b)
"""


def class_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each language has enough independent sources without blockers."""
    rows = _admission(spark, sf_dir).withColumn("candidate", F.size("blockers") == 0)
    out = routing.review_classes(rows, "lang", "source", "candidate")
    return out.select("lang", "panels", "groups", "eligible_groups", "status", F.array_join("blockers", "|").alias("blockers"))


_CLASSES = _ADMISSION + """,
g AS (SELECT lang, count(*) AS panels, count(DISTINCT source) AS groups,
  count(DISTINCT source) FILTER (doc_id NOT IN (SELECT doc_id FROM b)) AS eligible_groups FROM d GROUP BY lang)
SELECT lang, panels, groups, eligible_groups, CASE WHEN eligible_groups >= 3 THEN 'independence_review_possible' ELSE 'collection_required' END AS status,
  concat_ws('|', CASE WHEN eligible_groups < 1 THEN 'no_panel_review_candidates' END,
    CASE WHEN eligible_groups < 2 THEN 'fewer_than_two_independent_eligible_source_groups' END,
    CASE WHEN eligible_groups < 3 THEN 'insufficient_independent_groups_for_train_validation_locked_eval_design' END) AS blockers
FROM g
"""

_PART_LANES = {"first": ("steel", "tin"), "second": ("brass", "copper"), "third": ("nickel",), "fourth": ("large", "small")}


def lane_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the first lane whose keyword their type or name holds; lanes without parts are there too."""
    routed = table(spark, sf_dir, "part").withColumn("lane", routing.first_lane(T.lineage(F.col("p_type"), F.col("p_name")), _PART_LANES, "gated"))
    lanes = spark.createDataFrame([(k,) for k in (*_PART_LANES, "gated", "empty")], "lane string")
    return routing.lane_counts(routed, lanes)


_LANES = """
WITH r AS (SELECT lower(p_type || ' ' || p_name) AS t FROM part),
l AS (SELECT CASE WHEN contains(t, 'steel') OR contains(t, 'tin') THEN 'first' WHEN contains(t, 'brass') OR contains(t, 'copper') THEN 'second'
  WHEN contains(t, 'nickel') THEN 'third' WHEN contains(t, 'large') OR contains(t, 'small') THEN 'fourth' ELSE 'gated' END AS lane FROM r)
SELECT v.lane, count(l.lane) AS n FROM (VALUES ('first'), ('second'), ('third'), ('fourth'), ('gated'), ('empty')) AS v(lane) LEFT JOIN l ON l.lane = v.lane GROUP BY v.lane
"""


def panel_status_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as figures: panelled if they have orders; segments and balances stand for host and value."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(counts, "c_custkey", "left")
    status, priority = routing.panel_status(F.coalesce("n", F.lit(0)) > 10, F.col("c_mktsegment") != "BUILDING", F.col("c_custkey") % 9 == 0, F.col("c_acctbal") > 3000)
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"), priority.alias("priority"))


_STATUS = """
WITH s AS (
  SELECT c_custkey, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) > 10 THEN 'panelized'
    WHEN c_mktsegment <> 'BUILDING' AND c_custkey % 9 <> 0 AND c_acctbal > 3000 THEN 'panelization_review_required'
    WHEN c_mktsegment <> 'BUILDING' THEN 'reference_review_required' ELSE 'not_cannabis_panel_priority' END AS status
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)
SELECT *, CASE status WHEN 'panelization_review_required' THEN 'P0' WHEN 'reference_review_required' THEN 'P1' ELSE 'P2' END AS priority FROM s
"""


def grid_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels of a grid: each region's bands by each of its nations, with their boxes."""
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.expr("transform(sequence(0, 2), i -> array(i * 100, i * 100 + 90))").alias("bands"))
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    grid = rows.join(nations, rows.r_regionkey == nations.n_regionkey).select("r_regionkey", "bands", F.posexplode("names").alias("column", "name"))
    cells = grid.select("r_regionkey", "name", "column", F.posexplode("bands").alias("row", "band"))
    box = F.array(F.col("column") * 50, F.col("band")[0], F.col("column") * 50 + 40, F.col("band")[1])
    return cells.select("r_regionkey", "name", F.col("column").cast("long").alias("column"), F.col("row").cast("long").alias("row"), F.array_join(box.cast("array<string>"), ",").alias("box"), T.box_fits(box, F.lit(200), F.lit(300)).alias("fits"))


_GRID = """
WITH n AS (SELECT n_regionkey, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS c FROM nation)
SELECT r_regionkey, name, CAST(c AS BIGINT) AS "column", CAST(r AS BIGINT) AS "row",
  concat_ws(',', c * 50, r * 100, c * 50 + 40, r * 100 + 90) AS box, c * 50 + 40 <= 200 AND r * 100 + 90 <= 300 AS fits
FROM region JOIN n ON n_regionkey = r_regionkey, unnest(range(0, 3)) AS t(r)
"""

QUERIES: dict[str, Entry] = {
    "merge_conflicts": (merge_conflicts, _CONFLICTS),
    "merge_last_non_null": (merge_last_non_null, _LAST),
    "exact_dup_groups": (exact_dup_groups, _EXACT),
    "exact_cross_class": (exact_cross_class, _CROSS),
    "near_dup_edges": (near_dup_edges, _EDGES),
    "near_dup_probe": (near_dup_probe, _PROBE),
    "near_dup_components": (near_dup_components, _COMPONENTS),
    "near_dup_cross_group": (near_dup_cross_group, _CROSS_GROUP),
    "near_dup_edge_counts": (near_dup_edge_counts, _EDGE_COUNTS),
    "exact_dup_members": (exact_dup_members, _MEMBERS),
    "split_leakage": (split_leakage, _LEAKAGE),
    "choose_split": (choose_split, SPLIT_SQL),
    "admission_blockers": (admission_blockers, _BLOCKERS),
    "class_admission": (class_admission, _CLASSES),
    "lane_router": (lane_router, _LANES),
    "panel_status_priority": (panel_status_priority, _STATUS),
    "grid_expand": (grid_expand, _GRID),
}
