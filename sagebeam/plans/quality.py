"""Search, coverage, validation and order-dependent queries over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebeam.functions import text as T
from sagebeam.operators import annotations, coverage, merging, ordered, packing, routing
from sagebeam.operators import validation as V
from sagebeam.plans.tables import Entry, spread, table

_NEEDLE = " The and "


def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a language, and pages, whose text holds a needle: stripped for the one, as typed for the other."""
    needle = T.normalise(F.lit(_NEEDLE))
    docs = table(spark, sf_dir, "documents").where(F.contains(F.lower(F.concat_ws(" ", "source", "text")), needle) & (F.col("lang") == "en"))
    pages = table(spark, sf_dir, "pages").where(F.contains(F.lower("html"), F.lower(F.lit(_NEEDLE))))
    return docs.select(F.lit("documents").alias("dataset"), F.col("doc_id").alias("id")).unionByName(pages.select(F.lit("pages").alias("dataset"), F.col("page_id").alias("id")))


_SEARCH = """
SELECT 'documents' AS dataset, doc_id AS id FROM documents WHERE contains(lower(source || ' ' || text), 'the and') AND lang = 'en'
UNION ALL SELECT 'pages', page_id FROM pages WHERE contains(lower(html), ' the and ')
"""


def facet_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, in their order, that have a customer with a debt."""
    debtors = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_nationkey").distinct()
    nations = table(spark, sf_dir, "nation").join(debtors, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    return table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left_semi").select("r_regionkey", "r_name")


_FACET = "SELECT r_regionkey, r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal < 0)"


def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per nation against a target, none for every fifth nation, in both ways of counting percent."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name", F.when(F.col("n_nationkey") % 5 != 0, 40 + F.col("n_nationkey")).alias("target"))
    customers = table(spark, sf_dir, "customer").withColumn("nation", F.col("c_nationkey"))
    out = coverage.roll_up(nations, customers, "nation", {"in_debt": F.col("c_acctbal") < 0, "rich": F.col("c_acctbal") > 8000})
    return out.select("n_name", "n", "in_debt", "rich", coverage.percent_capped(F.col("n"), F.col("target")).alias("capped"), coverage.percent_exact(F.col("in_debt"), F.col("target")).alias("exact"))


_COVERAGE = """
WITH c AS (
  SELECT n_name, CASE WHEN n_nationkey % 5 <> 0 THEN 40 + n_nationkey END AS target, count(c_custkey) AS n,
    count(*) FILTER (c_acctbal < 0) AS in_debt, count(*) FILTER (c_acctbal > 8000) AS rich
  FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey)
SELECT n_name, n, in_debt, rich, CAST(CASE WHEN target > 0 THEN least(100, floor(100.0 * n / target + 0.5)) ELSE 0 END AS BIGINT) AS capped,
  CASE WHEN target > 0 THEN floor((1000.0 * in_debt)::DOUBLE / target + 0.5) / 10 END::DOUBLE AS exact
FROM c
"""


def weakness_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty customers with the least behind them, by orders, lines and balance."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("orders"), F.sum(F.coalesce("lines", F.lit(0))).alias("lines"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"))
    rows = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").fillna(0, ["orders", "lines", "filled"])
    score = coverage.weakness(F.col("orders"), F.col("lines"), F.col("filled"), F.col("filled") + 1, F.col("lines"), F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") > 0)
    return ordered.weakest(rows.select("c_custkey", "c_name", score.cast("long").alias("score")), "score", "c_name")


_WEAKNESS = """
WITH l AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey, count(*) AS orders, sum(coalesce(lines, 0)) AS lines, count(*) FILTER (o_orderstatus = 'F') AS filled FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1),
c AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines, coalesce(filled, 0) AS filled FROM customer LEFT JOIN o ON o_custkey = c_custkey)
SELECT c_custkey, c_name, CAST(CASE WHEN orders < 1 THEN 8 ELSE 0 END + CASE WHEN lines < 2 THEN 5 ELSE 0 END + CASE WHEN filled < 2 THEN 4 ELSE 0 END
  + CASE WHEN filled + 1 < 2 THEN 4 ELSE 0 END + CASE WHEN lines < 2 THEN 5 ELSE 0 END + CASE WHEN c_mktsegment <> 'BUILDING' THEN 3 ELSE 0 END
  + CASE WHEN c_acctbal > 0 THEN 0 ELSE 2 END AS BIGINT) AS score
FROM c ORDER BY score DESC, c_name LIMIT 30
"""


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against what their lines add up to: how many are missing, unexpected, changed or the same, and in what."""
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.floor(F.col("o_totalprice") / 100_000).alias("band"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_linestatus").alias("status"), F.floor(F.sum("l_extendedprice") / 100_000).alias("band"))
    found = merging.full_diff(expected, lines, "key", ["status", "band"])
    return found.groupBy("state", F.coalesce(F.array_join("changed", "|"), F.lit("")).alias("changed")).agg(F.count("*").alias("rows"))


_DIFF = """
WITH e AS (SELECT o_orderkey AS key, o_orderstatus AS status, floor(o_totalprice / 100000) AS band FROM orders),
a AS (SELECT l_orderkey AS key, max(l_linestatus) AS status, floor(sum(l_extendedprice) / 100000) AS band FROM lineitem GROUP BY 1),
j AS (SELECT e.key AS ek, a.key AS ak, concat_ws('|', CASE WHEN e.status IS DISTINCT FROM a.status THEN 'status' END, CASE WHEN e.band IS DISTINCT FROM a.band THEN 'band' END) AS c FROM e FULL JOIN a ON e.key = a.key),
s AS (SELECT CASE WHEN ak IS NULL THEN 'missing' WHEN ek IS NULL THEN 'unexpected' WHEN c <> '' THEN 'changed' ELSE 'same' END AS state, CASE WHEN ak IS NULL OR ek IS NULL THEN '' ELSE c END AS changed FROM j)
SELECT state, changed, count(*) AS rows FROM s GROUP BY state, changed
"""


def referential_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a parent, by dataset and rule: lines, labels and nations, which have theirs, and customers without orders, parts and suppliers without lines, documents without labels."""
    of = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "supplier", "labels", "documents", "nation", "region", "customer")}
    of["lineitem"] = of["lineitem"].withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    found = [
        V.orphans(of[rows], rows, key, field, of[parents], parent)
        for rows, key, field, parents, parent in (
            ("lineitem", "line", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "line", "l_partkey", "part", "p_partkey"), ("lineitem", "line", "l_suppkey", "supplier", "s_suppkey"),
            ("labels", "doc_id", "doc_id", "documents", "doc_id"), ("nation", "n_nationkey", "n_regionkey", "region", "r_regionkey"), ("customer", "c_custkey", "c_custkey", "orders", "o_custkey"),
            ("part", "p_partkey", "p_partkey", "lineitem", "l_partkey"), ("supplier", "s_suppkey", "s_suppkey", "lineitem", "l_suppkey"), ("documents", "doc_id", "doc_id", "labels", "doc_id"))]
    return reduce(DataFrame.unionByName, found).groupBy("dataset", "rule").agg(F.count("*").alias("n"), F.min("row_key").alias("first"))


_ORPHANS = """
WITH v AS (
  SELECT 'lineitem' AS dataset, 'l_orderkey has no parent' AS rule, l_orderkey || '-' || l_linenumber AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'lineitem', 'l_partkey has no parent', l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT 'lineitem', 'l_suppkey has no parent', l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT 'labels', 'doc_id has no parent', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'nation', 'n_regionkey has no parent', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
  UNION ALL SELECT 'customer', 'c_custkey has no parent', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT 'part', 'p_partkey has no parent', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
  UNION ALL SELECT 'supplier', 's_suppkey has no parent', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)
  UNION ALL SELECT 'documents', 'doc_id has no parent', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT dataset, rule, count(*) AS n, min(k) AS first FROM v GROUP BY dataset, rule
"""


def field_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of form, value, URL and implication rules over customers, pages and documents."""
    customers = V.violations(table(spark, sf_dir, "customer"), "customer", "c_custkey", [V.pattern("c_name", "^Customer#[0-9]{5,9}$"), V.one_of("c_mktsegment", "BUILDING", "MACHINERY"), V.implies("debt outside building", F.col("c_acctbal") < 0, F.col("c_mktsegment") == "BUILDING")])
    pages = V.violations(table(spark, sf_dir, "pages"), "pages", "page_id", [V.is_url("url"), V.pattern("url", "^https://")])
    docs = V.violations(table(spark, sf_dir, "documents"), "documents", "doc_id", [*V.required("text", "lang"), V.Rule("text is short", F.col("n_chars") >= 100), V.holds_all(F.col("text"), "text names its tongue", "e", "a")])
    twice = V.repeated(table(spark, sf_dir, "documents").withColumn("digest", F.sha2("text", 256)), "documents", "digest").withColumn("row_key", F.substring("row_key", 1, 8))
    found = customers.unionByName(pages).unionByName(docs).unionByName(twice)
    return found.groupBy("dataset", "rule").agg(F.count("*").alias("n"))


_FIELDS = """
WITH v AS (
  SELECT 'customer' AS dataset, 'c_name has the wrong form' AS rule FROM customer WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]{5,9}')
  UNION ALL SELECT 'customer', 'c_mktsegment is not allowed' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
  UNION ALL SELECT 'customer', 'debt outside building' FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING'
  UNION ALL SELECT 'pages', 'url is no URL' FROM pages WHERE NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/\\s]+')
  UNION ALL SELECT 'pages', 'url has the wrong form' FROM pages WHERE url NOT LIKE 'https://%'
  UNION ALL SELECT 'documents', 'text is required' FROM documents WHERE trim(text) = ''
  UNION ALL SELECT 'documents', 'lang is required' FROM documents WHERE trim(lang) = ''
  UNION ALL SELECT 'documents', 'text is short' FROM documents WHERE n_chars < 100
  UNION ALL SELECT 'documents', 'text names its tongue' FROM documents WHERE NOT (contains(lower(text), 'e') AND contains(lower(text), 'a'))
  UNION ALL SELECT 'documents', 'digest is not unique' FROM (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1) AS t)
SELECT dataset, rule, count(*) AS n FROM v GROUP BY dataset, rule
"""

_COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")
_EXPECTED = {"region": 5, "nation": 25, "customer": 1500, "supplier": 100, "part": 2000, "orders": 15000, "lineitem": 60000, "events": 10000, "documents": 1001, "holdout": 0}


def count_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the tables against a manifest, one row per metric of either side."""
    actual = None
    for name in _COUNTED:
        one = table(spark, sf_dir, name).agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        actual = one if actual is None else actual.unionByName(one)
    return V.reconcile(actual, spark.createDataFrame(list(_EXPECTED.items()), "metric string, value long"))


_RECONCILE = f"""
WITH a(metric, actual) AS ({" UNION ALL ".join(f"SELECT '{t}', count(*) FROM {t}" for t in _COUNTED)}),
e(metric, expected) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in _EXPECTED.items())})
SELECT coalesce(a.metric, e.metric) AS metric, actual, CAST(expected AS BIGINT) AS expected, coalesce(actual = expected, false) AS agrees FROM a FULL JOIN e ON a.metric = e.metric
"""


def prefix_sum_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as uploads: of a customer's first eight those within a budget, of an allowed priority."""
    orders = table(spark, sf_dir, "orders")
    out = ordered.admit_by_budget(orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", most=400_000.0, budget=900_000.0, allowed=F.col("o_orderpriority") != "5-LOW")
    return out.select("o_custkey", "o_orderkey", F.col("position").cast("long").alias("position"), F.round("running", 2).alias("running"))


_ADMIT = """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders),
r AS (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY position) AS running FROM p WHERE position <= 8 AND o_totalprice > 0 AND o_totalprice <= 400000)
SELECT o_custkey, o_orderkey, position, round(running, 2) AS running FROM r WHERE running <= 900000 AND o_orderpriority <> '5-LOW'
"""


def anchored_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events, two a day from the first event after the last day's end."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.to_timestamp("ts")) / 1e6).alias("seconds"))
    out = ordered.rate_limited(events, "user_id", "seconds", "event_id", window=86_400, most=2)
    return out.select("user_id", "event_id", F.round("window_start", 3).alias("window_start"), F.col("count").cast("long").alias("count"), "accepted")


_LIMIT = """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (
  SELECT user_id, event_id, i, t AS s, 1 AS c FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.t - r.s >= 86400 THEN e.t ELSE r.s END, CASE WHEN e.t - r.s >= 86400 THEN 1 ELSE r.c + 1 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, round(s, 3) AS window_start, CAST(c AS BIGINT) AS count, c <= 2 AS accepted FROM r
"""


def annotation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and pages' numbers as boxes, as annotation files: the profile of the first 5,000 lines that are not blank, by names."""
    docs = spread(table(spark, sf_dir, "documents")).select(F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt")).alias("path"), "text")
    unit = lambda k: F.concat(F.lit("0."), F.lpad(F.pmod(F.col("page_id") * k, F.lit(1000)).cast("string"), 3, "0"))
    pages = table(spark, sf_dir, "pages")
    box = F.concat_ws(" ", F.pmod("page_id", F.lit(9)).cast("string"), unit(7), unit(11), F.when(F.pmod("page_id", F.lit(5)) == 0, "1.5").otherwise(unit(13)), unit(17))
    boxes = pages.select(F.concat(F.lit("b/"), F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit(".txt")).alias("path"), F.concat(F.lit("\n"), box, F.lit("\r\n \t\n-1e3 nan")).alias("text"))
    return annotations.profile(annotations.sampled(docs.unionByName(boxes)))


_SAMPLE = r"""
WITH files AS (
  SELECT 'd/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.txt' AS path, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b/' || lpad(CAST(page_id AS VARCHAR), 9, '0') || '.txt',
    chr(10) || (page_id % 9) || ' 0.' || lpad(CAST(page_id * 7 % 1000 AS VARCHAR), 3, '0') || ' 0.' || lpad(CAST(page_id * 11 % 1000 AS VARCHAR), 3, '0') || CASE WHEN page_id % 5 = 0 THEN ' 1.5' ELSE ' 0.' || lpad(CAST(page_id * 13 % 1000 AS VARCHAR), 3, '0') END
    || ' 0.' || lpad(CAST(page_id * 17 % 1000 AS VARCHAR), 3, '0') || chr(10) || '-1e3 nan' FROM pages),
split AS (SELECT path, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM files),
lines AS (SELECT path, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line, row_number() OVER (ORDER BY path, pos) AS r FROM split WHERE NOT regexp_full_match(raw, '\s*')),
s AS (SELECT *, regexp_split_to_array(line, '\s+') AS t FROM lines WHERE r <= 5000),
m AS (SELECT *, len(list_filter(t, lambda x: NOT regexp_full_match(x, '[+-]?[0-9]+([.][0-9]*)?(e[0-9]+)?|nan'))) = 0 AS num FROM s),
b AS (SELECT *, num AND len(t) = 5 AND len(list_filter(t[2:], lambda x: coalesce(TRY_CAST(x AS DOUBLE) NOT BETWEEN 0 AND 1, true))) = 0 AS box FROM m)
SELECT 'sampled' AS what, 0::BIGINT AS "at", count(*) AS n, NULL::VARCHAR AS text FROM b
UNION ALL SELECT 'numeric', 0, count(*) FILTER (num), NULL FROM b
UNION ALL SELECT 'yolo5', 0, count(*) FILTER (box), NULL FROM b
UNION ALL SELECT 'tokens', len(t), count(*), NULL FROM b GROUP BY len(t)
UNION ALL SELECT 'example', r - 1, NULL, substr(line, 1, 200) FROM b WHERE r <= 20
"""


def lpt_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations packed into four bins by their customers."""
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    nations = table(spark, sf_dir, "nation").join(counts, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))
    return packing.pack(nations, [], "n_name", "n", 4).select("n_name", "n", F.col("bin").cast("long").alias("bin"))


_BINS = """
WITH RECURSIVE c AS (SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, lower(n_name), n_name) AS i FROM c),
r AS (
  SELECT 0::BIGINT AS i, [0, 0, 0, 0]::BIGINT[] AS load, 0::BIGINT AS bin
  UNION ALL SELECT o.i, list_transform([1, 2, 3, 4], lambda k: r.load[k] + CASE WHEN k = list_position(r.load, list_min(r.load)) THEN o.n ELSE 0 END), (list_position(r.load, list_min(r.load)) - 1)::BIGINT
  FROM r JOIN o ON o.i = r.i + 1)
SELECT n_name, n, bin FROM r JOIN o USING (i)
"""


def token_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines by their number of tokens, and the shares that are numbers throughout or have five tokens."""
    lines = spread(table(spark, sf_dir, "documents")).select(F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    tokens = F.split(F.trim("line"), " +")
    numeric = F.forall(tokens, lambda t: t.try_cast("double").isNotNull())
    rows = lines.select(F.size(tokens).cast("long").alias("tokens"), numeric.alias("numeric"))
    return rows.groupBy("tokens").agg(F.count("*").alias("lines"), F.count_if("numeric").alias("numeric"))


_PROFILE = """
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT regexp_split_to_array(trim(line, ' '), ' +') AS t FROM l WHERE trim(line, ' ') <> '')
SELECT CAST(len(t) AS BIGINT) AS tokens, count(*) AS lines, count(*) FILTER (len(list_filter(t, lambda x: TRY_CAST(x AS DOUBLE) IS NULL)) = 0) AS "numeric" FROM t GROUP BY 1
"""


def quality_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: sizes from their characters, sides from their ids, by the notes that they get."""
    docs = table(spark, sf_dir, "documents")
    width, height = F.col("doc_id") % 2000 + 300, F.col("doc_id") % 1300 + 200
    notes = routing.file_notes(F.col("lang") == "de", F.col("n_chars") * 100, width, height, F.col("doc_id") % 40)
    return docs.groupBy(F.array_join(notes, "|").alias("notes"), F.when(F.size(notes) == 0, "good").otherwise("review").alias("state")).agg(F.count("*").alias("n"))


_NOTES = """
WITH d AS (SELECT lang = 'de' AS v, n_chars * 100 AS s, doc_id % 2000 + 300 AS w, doc_id % 1300 + 200 AS h, doc_id % 40 AS t FROM documents),
n AS (SELECT concat_ws('|', CASE WHEN s < 90000 THEN 'small file' END, CASE WHEN s > 18000000 THEN 'large file' END, CASE WHEN v AND t > 30.5 THEN 'long video' END,
  CASE WHEN CASE WHEN v THEN w < 720 OR h < 480 ELSE w < 900 OR h < 700 END THEN 'low resolution' END, CASE WHEN NOT v AND greatest(w, h)::DOUBLE / least(w, h) > 3 THEN 'extreme aspect ratio' END) AS notes FROM d)
SELECT notes, CASE WHEN notes = '' THEN 'good' ELSE 'review' END AS state, count(*) AS n FROM n GROUP BY notes
"""


def clean_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns split at commas into lists, stripped, cut and capped."""
    parts = T.clean_list(F.split("text", ","), 12, 5)
    words = T.vocabulary(F.split("text", " "), 8, 10)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(parts, "|").alias("parts"), F.array_join(words, "|").alias("words"))


_CLEAN = """
SELECT conv_id, turn,
  array_to_string(list_filter(list_transform(string_split(text, ','), lambda v: trim(v)[1:12]), lambda v: v <> '')[1:5], '|') AS parts,
  array_to_string(list_transform(list_sort(list_distinct(list_transform(
    list_filter(list_transform(string_split(text, ' '), lambda v: trim(v)), lambda v: v <> '' AND length(v) <= 8),
    lambda v: {'p': list_position(list_transform(string_split(text, ' '), lambda y: trim(y)), v), 'v': v}))), lambda s: s.v)[1:10], '|') AS words
FROM conversations
"""


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of a simple length rule against the quality labels."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("quality", F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("predicted"))
    out = coverage.class_metrics(rows, "quality", "predicted")
    return out.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_METRICS = """
WITH r AS (SELECT quality AS y, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT y AS label, count(*) AS support, count(*) FILTER (y = p) AS hits, (SELECT count(*) FROM r AS q WHERE q.p = r.y) AS said FROM r GROUP BY y),
m AS (SELECT label, support, CASE WHEN said > 0 THEN hits::DOUBLE / said ELSE 0 END AS precision, hits::DOUBLE / support AS recall FROM c)
SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM m
"""

QUERIES: dict[str, Entry] = {
    "search_filter": (search_filter, _SEARCH),
    "facet_presence": (facet_presence, _FACET),
    "coverage_rollup": (coverage_rollup, _COVERAGE),
    "weakness_top30": (weakness_top30, _WEAKNESS),
    "snapshot_diff": (snapshot_diff, _DIFF),
    "referential_violations": (referential_violations, _ORPHANS),
    "field_rule_violations": (field_rule_violations, _FIELDS),
    "count_reconcile": (count_reconcile, _RECONCILE),
    "prefix_sum_admit": (prefix_sum_admit, _ADMIT),
    "anchored_rate_limit": (anchored_rate_limit, _LIMIT),
    "annotation_sample": (annotation_sample, _SAMPLE),
    "lpt_bins": (lpt_bins, _BINS),
    "token_profile": (token_profile, _PROFILE),
    "quality_notes": (quality_notes, _NOTES),
    "clean_lists": (clean_lists, _CLEAN),
    "eval_metrics": (eval_metrics, _METRICS),
}
