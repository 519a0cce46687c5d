"""The queries ``opN_<name>`` over the test tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sagebeam.llm import centroids, codes, decontaminate, embeddings, langid, licenses, lm, minhash, mixing, quality, toxicity, urls, warc
from sagebeam.llm.frames import Query, spread, table


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), floor=0.95)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(spread(table(spark, sf_dir, "documents")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spread(table(spark, sf_dir, "documents")))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spread(table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(spread(table(spark, sf_dir, "documents")))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spread(table(spark, sf_dir, "documents")), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.rule_table(spark, urls.RULES), urls.junk_pages(pages)).drop("listed")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_embeddings, op2_decontaminate, op3_quality, op4_mixing, op5_licenses, op6_langid, op7_toxicity, op8_warc, op9_lm, op10_minhash, op11_centroids, op12_urls, op13_codes)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP2 = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM} AS w FROM documents),
items AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
phrases AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
places AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM docs, (SELECT DISTINCT n FROM phrases) AS l, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT rid, i, n, item_id FROM places JOIN phrases USING (n, g)),
covered AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM hits) AS h, unnest(range(i, i + n)) AS t(j) GROUP BY rid),
found AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
"""


_OP4 = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    substr(md5(concat('mix', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 16) AS key FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM totals),
filled AS (
  SELECT *, sum(cap) OVER o - cap AS held, sum(w) OVER () - (sum(w) OVER o - w) AS free, sum(source_size::DOUBLE) OVER () AS whole
  FROM weighed WINDOW o AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
level AS (SELECT max((whole - held) / free) AS v FROM filled),
goals AS (SELECT source, source_size, least(cap, w * v) AS target, CAST(round(least(cap, w * v)) AS BIGINT) AS goal FROM filled, level),
ahead AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized),
parts AS (
  SELECT a.*, source_size, target, CASE WHEN source_size > 0 THEN least(goal // source_size, 3) ELSE 0 END AS epochs, goal
  FROM ahead AS a JOIN goals AS g ON a.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, goal - epochs * source_size - before)) AS BIGINT) AS taken FROM parts
"""

_OP8 = """
WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS first FROM sized WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM sized LEFT JOIN firsts USING (digest)
"""

_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in licenses.TEMPLATES.items())
_TELLING = ", ".join(f"('{k}', '{p}')" for k, ps in licenses.TELLING.items() for p in ps)
_PHRASES = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items())

_OP5 = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM} AS w FROM documents),
word AS (SELECT rid, i - 1 AS p, w[i] AS x FROM docs, unnest(range(1, len(w) + 1)) AS t(i)),
phrases AS (SELECT string_split(p, ' ') AS q, label FROM (VALUES {_PHRASES}) AS t(p, label)),
places AS (
  SELECT rid, p, label FROM word JOIN docs USING (rid) JOIN phrases ON x = q[1] AND w[p + 1 : p + len(q)] = q),
base AS (SELECT rid, count(*) AS n, min(p) AS a, max(p) AS b, list_sort(list(DISTINCT label)) AS named FROM places GROUP BY rid),
templates AS (
  SELECT label, len(string_split(v, ' ')) AS span, list_distinct(string_split(v, ' ')) AS s FROM (VALUES {_VALUES}) AS t(label, v)),
parts AS (SELECT label, span, len(s) AS n, unnest(s) AS x FROM templates),
met AS (
  SELECT rid, label, block, max(n) AS n, count(DISTINCT x) AS shared
  FROM (SELECT rid, label, n, x, unnest(list_distinct([p // span, greatest(p // span - 1, 0)])) AS block FROM word JOIN parts USING (x))
  GROUP BY rid, label, block HAVING count(DISTINCT x) >= ceil(max(n) * {licenses.CONTAINMENT} - 1e-9)),
telling AS (SELECT label, list(' ' || phrase || ' ') AS ps FROM (VALUES {_TELLING}) AS t(label, phrase) GROUP BY label),
told AS (
  SELECT met.* FROM met JOIN docs USING (rid) JOIN (SELECT DISTINCT label, span FROM templates) AS s USING (label) LEFT JOIN telling USING (label)
  WHERE len(list_filter(coalesce(ps, []), lambda p: NOT contains(' ' || array_to_string(w[block * span + 1 : block * span + 2 * span], ' ') || ' ', p))) = 0),
own AS (SELECT rid, max(CAST(shared AS DOUBLE) / n) AS best, list(DISTINCT replace(label, '-notice', '')) AS found FROM told GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word,
  coalesce(array_to_string(named, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(named, []), coalesce(found, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM docs LEFT JOIN base USING (rid) LEFT JOIN own USING (rid)
"""


_OP1 = """
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sound AS (
  SELECT rid, vec_id, v FROM rows
  WHERE coalesce(len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0, false)),
links AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM sound AS a JOIN sound AS b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT rid AS a, rid AS b FROM rows UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
least AS (SELECT a AS rid, min(vec_id) AS component_id FROM reach JOIN rows ON rid = b GROUP BY a),
counts AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM rows JOIN least USING (rid) LEFT JOIN counts USING (rid)
"""

_OP10 = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT rid, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM docs),
sizes AS (SELECT rid, count(*) AS n FROM sets GROUP BY rid),
shared AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM sets AS x JOIN sets AS y ON x.g = y.g AND x.rid < y.rid GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes AS x ON x.rid = a JOIN sizes AS y ON y.rid = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rid AS a, rid AS b FROM docs UNION SELECT r.a, l.b FROM reach AS r JOIN both_ways AS l ON r.b = l.a),
least AS (SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN docs ON rid = b GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM docs JOIN least USING (rid) LEFT JOIN sizes USING (rid)
"""


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)

_OP12 = rf"""
WITH cut AS (
  SELECT row_number() OVER () AS rid, page_id, position('://' IN coalesce(url, '')) > 0 AS sound, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', ['host', 'path']) AS m FROM pages),
parts AS (SELECT rid, page_id, translate(m.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, m.path AS path FROM cut),
named AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '(?:/index)?(?:\.html?)?/*$', '') END AS canon FROM parts),
listed AS (SELECT DISTINCT canon FROM named WHERE regexp_matches(host, '(?:^|[.-])(?:{'|'.join(urls.JUNK)})(?:[.-]|$)')),
rules AS (SELECT * FROM (VALUES {_RULES}) AS t(verdict, rhost, rpath)),
fits AS (
  SELECT rid, arg_max(rhost || rpath, len(rhost || rpath) * 1000 + len(rhost)) AS rule, arg_max(verdict, len(rhost || rpath) * 1000 + len(rhost)) AS said
  FROM named JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN canon IN (FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM named LEFT JOIN fits USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embeddings": _OP1, "op10_minhash": _OP10, "op12_urls": _OP12, "op2_decontaminate": _OP2, "op4_mixing": _OP4, "op5_licenses": _OP5, "op8_warc": _OP8}
