"""Ranking, gating, adjudication and media queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagebeam.functions import text as T
from sagebeam.operators import adjudication, merging, ordered, ranking, revisions
from sagebeam.plans.tables import Entry, spread, table

_TOKEN = "[^a-z0-9]+"
EXCLUDED = ("the", "and", "of", "le", "la", "der", "die", "que", "de")


def _signs(spark: SparkSession, sf_dir: str, name: str, key: str, alias: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias(alias), F.explode(_words("text")).alias("key"))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best documents of each benchmark item by the words that they share."""
    listed = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("record_id"), _words("text").alias("keys")).where("keys is not null")
    return ranking.top_per_case(ranking.top_support(listed, _signs(spark, sf_dir, "benchmark", "item_id", "case_id")), "record_id")


_SCORES = """
WITH ind AS (SELECT DISTINCT doc_id AS record_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS key FROM documents),
sym AS (SELECT DISTINCT item_id AS case_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS key FROM benchmark),
freq AS (SELECT key, count(*) AS f FROM ind WHERE key <> '' GROUP BY key),
w AS (SELECT key, CASE WHEN f <= 1 THEN 4.0 WHEN f = 2 THEN 3.5 WHEN f <= 4 THEN 3.0 WHEN f <= 8 THEN 2.5 ELSE 2.0 END::DOUBLE AS w FROM freq),
pairs AS (SELECT case_id, record_id, sum(w) AS score, count(*) AS n_matched FROM sym JOIN ind USING (key) JOIN w USING (key) GROUP BY case_id, record_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, record_id) - 1 AS rank FROM pairs WHERE score > 0),
top AS (SELECT *, lead(score) OVER (PARTITION BY case_id ORDER BY rank) AS next_score FROM ranked WHERE rank < 4)
"""


def rarity_rank_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items are cases, documents records, distinct tokens signs."""
    return _best(spark, sf_dir).select("case_id", F.col("rank").cast("long").alias("rank"), "record_id", "score", "n_matched", (F.col("score") - F.col("next_score")).alias("margin"))


_RANK = _SCORES + "SELECT case_id, CAST(rank AS BIGINT) AS rank, record_id, score, n_matched, score - next_score AS margin FROM top"


def rank_confidence_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking with evidence gates and ceilings: languages stand for categories, sources for policies."""
    best = _best(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "lang", "source")
    category = F.when(F.col("lang") == "en", "Insect").when(F.col("lang") == "fr", "Mite").when(F.col("lang") == "de", "Nutrient deficiency").otherwise("Virus")
    case = F.col("case_id")
    has = {"whole-plant": case % 5 != 0, "close-up": case % 7 != 0, "underside": case % 2 == 0, "root-crown": F.lit(False)}
    ph = F.when(case % 3 == 0, "6.1").otherwise("")
    out = best.join(docs, "record_id")
    level = ranking.gated_band(F.col("score"), F.col("n_matched"), F.lit(0), category, F.lit(""), has, ph, F.lit("1.2"))
    missing = ranking.asked(category, F.lit(""), has, ph, F.lit("1.2"), F.lit(""))
    own = F.col("source")
    ceiling = F.when(own == "src0", 0.92).when(own == "src1", 0.5).when(own == "src2", 93.0).otherwise(0.8)
    required = F.when(own == "src1", F.array(F.lit("second reader"), F.lit("source check"))).otherwise(F.expr("cast(array() as array<string>)"))
    level, missing = ranking.with_policy(level, missing, F.lit(None).cast("double"), ceiling, F.when(own.isin("src1", "src2"), "false").otherwise("true"), required)
    level, missing = ranking.after_ranking(level, missing)
    return out.select("case_id", F.col("rank").cast("long").alias("rank"), "record_id", "score", T.band_name(level).alias("confidence"), F.array_join(missing, "|").alias("missing"))


_GATED = _SCORES + """,
facts AS (
  SELECT top.*, source, CASE lang WHEN 'en' THEN 'I' WHEN 'fr' THEN 'M' WHEN 'de' THEN 'N' ELSE 'V' END AS c,
    case_id % 5 <> 0 AS whole, case_id % 7 <> 0 AS close, case_id % 2 = 0 AS under, case_id % 3 = 0 AS ph,
    next_score IS NOT NULL AND rank = 0 AND score - next_score < 2 AS tight
  FROM top JOIN documents ON doc_id = record_id),
base AS (
  SELECT *, least(
    CASE WHEN score >= 10 AND n_matched >= 3 THEN 2 WHEN score >= 5 AND n_matched >= 2 THEN 1 ELSE 0 END,
    CASE WHEN c = 'V' OR (c = 'M' AND NOT under) THEN 0 WHEN (c = 'I' AND NOT under) OR (c = 'N' AND NOT ph) OR NOT whole OR NOT close THEN 1 ELSE 2 END) AS gated
  FROM facts),
capped AS (SELECT *, least(gated, CASE source WHEN 'src0' THEN 2 WHEN 'src1' THEN 0 WHEN 'src2' THEN 2 ELSE 1 END) AS level FROM base)
SELECT case_id, CAST(rank AS BIGINT) AS rank, record_id, score,
  CASE CASE WHEN rank > 0 OR tight THEN least(level, 1) ELSE level END WHEN 2 THEN 'High' WHEN 1 THEN 'Moderate' ELSE 'Low' END AS confidence,
  concat_ws('|',
    CASE WHEN NOT whole THEN 'whole-plant view' END, CASE WHEN NOT close THEN 'affected-tissue close-up' END,
    CASE WHEN c IN ('I', 'M') AND NOT under THEN 'leaf-underside image' END, CASE WHEN c = 'V' THEN 'validated laboratory test' END,
    CASE WHEN c = 'N' AND NOT ph THEN 'measured pH' END,
    CASE WHEN level <> gated THEN 'response policy limits photo-only confidence' END,
    CASE source WHEN 'src1' THEN 'confirmation: second reader|confirmation: source check' WHEN 'src2' THEN 'non-visual confirmation required by issue confidence policy' END,
    CASE WHEN tight THEN 'additional discriminating evidence between the leading look-alikes' END) AS missing
FROM capped
"""


def _words(column: str):
    return F.filter(F.array_distinct(F.split(F.lower(column), _TOKEN)), lambda w: w != "")


def rank_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as cases against documents as records, with contradictions, bonuses, policies and lists.

    Words are signs; common ones speak against English documents.  Languages stand
    for categories, sources for slugs and stages.
    """
    docs, items = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")
    lang, source, words = F.col("lang"), F.col("source"), _words("text")
    common = F.array(*[F.lit(w) for w in EXCLUDED])
    nothing = F.expr("cast(array() as array<string>)")
    records = docs.select(
        F.col("doc_id").alias("record_id"), F.col("doc_id").alias("catalog_pos"), F.when(lang == "en", "Insect").when(lang == "fr", "Mite").when(lang == "de", "Root pathogen").otherwise("Virus").alias("category"),
        source.alias("slug"), F.concat_ws("-", source, lang).alias("canonical_id"), F.when(source == "src4", "P-OWN").alias("response_policy_id"), F.when(source == "src5", 55.0).alias("photo_cap"),
        F.when(lang == "en", F.array_except(words, common)).otherwise(words).alias("indicators"), F.when(lang == "en", F.array_intersect(words, common)).otherwise(nothing).alias("exclusions"), F.array(source).alias("stages"))
    case = F.col("item_id")
    cases = items.select(case.alias("case_id"), F.when(case % 3 == 0, "src1").otherwise("").alias("stage"), F.when(case % 2 == 0, "6.1").otherwise("").alias("ph"), F.lit("1.2").alias("ec"), F.lit("").alias("watering"), _words("text").alias("symptoms"))
    seen = F.array_compact(F.array(*[F.when(has, F.lit(slot)) for has, slot in ((case % 5 != 0, "whole-plant"), (case % 7 != 0, "close-up"), (case % 2 == 0, "underside"), (case % 4 == 0, "root-crown"))]))
    media = items.select(case.alias("case_id"), F.explode(seen).alias("slot"))
    policies = spark.createDataFrame(
        [("POL-DEFAULT", [], 0.8, "provisional_only", [], 0), ("P-OWN", [], 0.92, "true", [], 1), ("P-CAN", ["src1-en", "src1-fr"], 0.5, "false", ["second reader", "source check"], 2), ("P-SLUG", [], 93.0, "false", [], 3)],
        "policy_id string, canonical_ids array<string>, cap double, can_confirm string, required array<string>, ord int")
    out = ranking.rank_cases(records, cases, media, policies, spark.createDataFrame([("src2", "P-SLUG")], "slug string, slug_policy string"))
    listed = lambda c: F.array_join(F.array_sort(c), " ").alias(c)
    return out.select("case_id", F.col("rank").cast("long").alias("rank"), "record_id", "score", "confidence", listed("supporting"), listed("contradicting"), F.array_join("missing", "|").alias("missing"))


_RANK_CASES = f"""
WITH tok AS (SELECT doc_id, lang, source, unnest(list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')), lambda x: x <> '')) AS key FROM documents),
signs AS MATERIALIZED (SELECT doc_id AS record_id, key, lang = 'en' AND key IN {EXCLUDED} AS bad FROM tok),
sym AS MATERIALIZED (SELECT item_id AS case_id, unnest(list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')), lambda x: x <> '')) AS key FROM benchmark),
freq AS (SELECT key, count(*) AS f FROM signs WHERE NOT bad GROUP BY key),
w AS (SELECT key, CASE WHEN f <= 1 THEN 4.0 WHEN f = 2 THEN 3.5 WHEN f <= 4 THEN 3.0 WHEN f <= 8 THEN 2.5 ELSE 2.0 END::DOUBLE AS w FROM freq),
parts AS (
  SELECT case_id, record_id, CASE WHEN bad THEN -greatest(4.0, coalesce(w, 4.0) + 1) ELSE w END AS v, CASE WHEN NOT bad THEN key END AS good, CASE WHEN bad THEN key END AS ill
  FROM sym JOIN signs USING (key) LEFT JOIN w USING (key)
  UNION ALL SELECT item_id, doc_id, 1.0, NULL, NULL FROM benchmark JOIN documents ON item_id % 3 = 0 AND source = 'src1'
  UNION ALL SELECT item_id, doc_id, 1.0, NULL, NULL FROM benchmark JOIN documents ON item_id % 4 = 0 AND lang = 'de'
  UNION ALL SELECT item_id, doc_id, 1.0, NULL, NULL FROM benchmark JOIN documents ON item_id % 2 = 0 AND lang IN ('en', 'fr')),
pairs AS (
  SELECT case_id, record_id, sum(v)::DOUBLE AS score, coalesce(string_agg(good, ' ' ORDER BY good), '') AS supporting, coalesce(string_agg(ill, ' ' ORDER BY ill), '') AS contradicting, count(good) AS n, count(ill) AS m
  FROM parts GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, record_id) - 1 AS rank FROM pairs WHERE score > 0),
top AS (SELECT *, lead(score) OVER (PARTITION BY case_id ORDER BY rank) AS next_score FROM placed WHERE rank < 4),
facts AS (
  SELECT top.*, source, lang, CASE lang WHEN 'en' THEN 'I' WHEN 'fr' THEN 'M' WHEN 'de' THEN 'R' ELSE 'V' END AS c, case_id % 5 <> 0 AS whole, case_id % 7 <> 0 AS close, case_id % 2 = 0 AS under, case_id % 4 = 0 AS root,
    rank = 0 AND next_score IS NOT NULL AND score - next_score < 2 AS tight,
    CASE WHEN source = 'src4' THEN 'own' WHEN source = 'src1' AND lang IN ('en', 'fr') THEN 'can' WHEN source = 'src2' THEN 'slug' ELSE 'default' END AS policy
  FROM top JOIN documents ON doc_id = record_id),
gated AS (
  SELECT *, least(CASE WHEN score >= 10 AND n >= 3 AND m = 0 THEN 2 WHEN score >= 5 AND n >= 2 THEN 1 ELSE 0 END,
    CASE WHEN c = 'V' OR (c = 'R' AND NOT root) OR (c = 'M' AND NOT under) THEN 0 WHEN (c = 'I' AND NOT under) OR NOT whole OR NOT close THEN 1 ELSE 2 END) AS gate
  FROM facts),
capped AS (SELECT *, least(gate, CASE WHEN source = 'src5' THEN 0 WHEN policy = 'own' THEN 2 WHEN policy = 'can' THEN 0 WHEN policy = 'slug' THEN 2 ELSE 1 END) AS level FROM gated)
SELECT case_id, CAST(rank AS BIGINT) AS rank, record_id, score, CASE CASE WHEN rank > 0 OR tight THEN least(level, 1) ELSE level END WHEN 2 THEN 'High' WHEN 1 THEN 'Moderate' ELSE 'Low' END AS confidence, supporting, contradicting,
  concat_ws('|', CASE WHEN NOT whole THEN 'whole-plant view' END, CASE WHEN NOT close THEN 'affected-tissue close-up' END, CASE WHEN c IN ('I', 'M') AND NOT under THEN 'leaf-underside image' END,
    CASE WHEN c = 'R' AND NOT root THEN 'root or crown view' END, CASE WHEN c = 'V' THEN 'validated laboratory test' END, CASE WHEN c = 'R' AND NOT under THEN 'measured pH' END,
    CASE WHEN c = 'R' THEN 'recent irrigation / substrate-moisture context' END, CASE WHEN level <> gate THEN 'response policy limits photo-only confidence' END,
    CASE policy WHEN 'can' THEN 'confirmation: second reader|confirmation: source check' WHEN 'slug' THEN 'non-visual confirmation required by issue confidence policy' END,
    CASE WHEN tight THEN 'additional discriminating evidence between the leading look-alikes' END) AS missing
FROM capped
"""


def contradiction_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common words stand for exclusions: what they take away from each case, summed over its documents."""
    signs = _signs(spark, sf_dir, "documents", "doc_id", "record_id")
    exclusions = signs.where(F.col("key").isin(*EXCLUDED))
    found = ranking.contradiction(exclusions, signs, _signs(spark, sf_dir, "benchmark", "item_id", "case_id"))
    return found.groupBy("case_id").agg(F.count("*").alias("n_records"), F.sum("n_contradicted").alias("n_signs"), F.sum("contradicting").alias("penalty"))


_PENALTY = _SCORES + f"""
SELECT case_id, count(DISTINCT record_id) AS n_records, count(*) AS n_signs, sum(greatest(4.0, w + 1))::DOUBLE AS penalty
FROM sym JOIN ind USING (key) JOIN w USING (key) WHERE key IN {EXCLUDED} GROUP BY case_id
"""


def adjudicate_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types are the candidates of each user, their mean value the score; every seventh user has an open check."""
    events = table(spark, sf_dir, "events")
    scored = events.groupBy("user_id", "event_type").agg(F.round(F.avg(F.least(F.abs("value") / 100, F.lit(1.0))), 10).alias("score"))
    placed = adjudication.ranked_candidates(scored, "user_id", "score", "event_type")
    ordered_list = F.array_sort(F.collect_list(F.struct("place", "event_type", "score")))
    out = placed.groupBy("user_id").agg(ordered_list.alias("c"))
    top, name = F.col("c")[0]["score"], F.col("c")[0]["event_type"]
    doubtful = (F.col("user_id") % 7 == 0) | ((F.col("user_id") % 10) / 10 >= adjudication.UNKNOWN_FROM)
    ceiling = F.when(name == "purchase", 0.4).when(name == "click", 0.6)
    return out.select(
        "user_id", name.alias("primary_type"), F.array_join(F.transform(F.slice("c", 2, 3), lambda x: x["event_type"]), "|").alias("alternatives"),
        adjudication.final_confidence(top, ceiling, doubtful).alias("final_confidence"), (doubtful | F.coalesce(name == "purchase", F.lit(False))).alias("provisional"))


_ADJUDICATE = """
WITH scored AS (SELECT user_id, event_type, round(avg(least(abs(value) / 100, 1.0)), 10) AS score FROM events GROUP BY user_id, event_type),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS place FROM scored),
tops AS (
  SELECT user_id, max(event_type) FILTER (place = 1) AS primary_type, max(score) FILTER (place = 1) AS top,
    coalesce(string_agg(event_type, '|' ORDER BY place) FILTER (place BETWEEN 2 AND 4), '') AS alternatives,
    user_id % 7 = 0 OR (user_id % 10) / 10.0 >= 0.55 AS doubtful
  FROM placed GROUP BY user_id)
SELECT user_id, primary_type, alternatives,
  least(top, CASE primary_type WHEN 'purchase' THEN 0.4 WHEN 'click' THEN 0.6 ELSE 0.8 END::DOUBLE, CASE WHEN doubtful THEN 0.59 ELSE 9 END::DOUBLE) AS final_confidence,
  doubtful OR primary_type = 'purchase' AS provisional
FROM tops
"""


def evidence_score_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as controlled evidence, best first within each language."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    level = F.when(F.col("quality") == 1, "Gold standard").when(F.col("toxic") == 1, "high agreement").otherwise("")
    reuse = F.when(F.col("n_chars") < 500, "REFERENCE_ONLY").otherwise("open")
    score = adjudication.evidence_score(F.col("source") == "src0", level, reuse)
    ranked = rows.select("lang", F.col("doc_id").alias("case_id"), score.cast("long").alias("score"))
    return ranked.select("lang", F.col("case_id").alias("doc_id"), "score", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "case_id")).cast("long").alias("place"))


_EVIDENCE = """
SELECT lang, d.doc_id, CAST(v AS BIGINT) AS score, row_number() OVER (PARTITION BY lang ORDER BY v DESC, d.doc_id) AS place
FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id, LATERAL (SELECT
  CASE WHEN source = 'src0' THEN 20 ELSE 0 END + CASE WHEN quality = 1 THEN 20 WHEN toxic = 1 THEN 12 ELSE 0 END - CASE WHEN n_chars < 500 THEN 1 ELSE 0 END AS v) AS s
"""


def evidence_resolve_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's even documents, and those odd ones whose text these lack: own rows before shared ones."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("digest"))
    out = merging.shared_by_key(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "source", F.col("digest"), "doc_id")
    return out.groupBy("source").agg(F.count("*").alias("n"), F.count_if("is_shared").alias("n_shared"), F.sum("doc_id").alias("id_sum"))


_SHARED = """
WITH k AS (SELECT source, sha256(text) AS digest, min(doc_id) FILTER (doc_id % 2 = 0) AS own, min(doc_id) AS any_id FROM documents GROUP BY 1, 2)
SELECT source, count(*) AS n, count(*) FILTER (own IS NULL) AS n_shared, CAST(sum(coalesce(own, any_id)) AS BIGINT) AS id_sum FROM k GROUP BY source
"""


def frame_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample times in the span of each user's events, in seconds."""
    seconds = F.unix_micros(F.to_timestamp("ts")) / 1e6
    spans = table(spark, sf_dir, "events").groupBy("user_id").agg((F.max(seconds) - F.min(seconds)).alias("span"))
    times = T.frame_times(F.col("span"))
    return spans.select("user_id", F.size(times).cast("long").alias("n"), F.round(F.aggregate(times, F.lit(0.0), lambda a, b: a + b), 2).alias("total"))


_FRAMES = """
WITH s AS (SELECT user_id, (epoch_us(max(ts)) / 1e6) - (epoch_us(min(ts)) / 1e6) AS d FROM events GROUP BY user_id),
t AS (SELECT DISTINCT user_id, round(least(greatest(x, 0), d), 2) AS x FROM s, LATERAL (SELECT unnest([least(0.5, d * 0.1), d * 0.5, d - 0.5]) AS x) AS l)
SELECT user_id, count(*) AS n, round(sum(x), 2) AS total FROM t GROUP BY user_id
"""


def latest_unsuperseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn of each conversation that no later turn supersedes."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.struct("conv_id", "turn").alias("id"), F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("before"))
    return ordered.current(turns, "id", "before").select("conv_id", "turn", "role")


_LATEST = """
SELECT conv_id, turn, role FROM conversations AS c
WHERE NOT EXISTS (SELECT 1 FROM conversations AS n WHERE n.conv_id = c.conv_id AND n.turn = c.turn + 1)
"""

def revision_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as revisions of the turn of half their number, events as those of the user's event before: each chain's head, length and heads."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    forked = turns.select(F.concat_ws("-", F.lit("c"), "conv_id", F.lpad(F.col("turn").cast("string"), 5, "0")).alias("id"), F.when(F.col("turn") > 0, F.concat_ws("-", F.lit("c"), "conv_id", F.lpad(F.floor(F.col("turn") / 2).cast("string"), 5, "0"))).alias("before"))
    by_user = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    name = lambda c: F.when(c.isNotNull(), F.concat(F.lit("e-"), F.lpad(c.cast("string"), 12, "0")))
    followed = table(spark, sf_dir, "events").select(name(F.col("event_id")).alias("id"), name(F.lag("event_id").over(by_user)).alias("before"))
    return revisions.chains(forked.where("not id <=> before").unionByName(followed), "id", "before")


_CHAINS = """
WITH RECURSIVE turns AS (SELECT DISTINCT conv_id, turn FROM conversations),
rows AS MATERIALIZED (
  SELECT format('c-{}-{:05d}', conv_id, turn) AS id, CASE WHEN turn > 0 THEN format('c-{}-{:05d}', conv_id, turn // 2) END AS before FROM turns
  UNION ALL SELECT format('e-{:012d}', event_id), 'e-' || lpad(CAST(lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS VARCHAR), 12, '0') FROM events),
walk AS (
  SELECT id, id AS root, 0 AS depth FROM rows WHERE before IS NULL OR before NOT IN (SELECT id FROM rows)
  UNION ALL SELECT r.id, w.root, w.depth + 1 FROM walk AS w JOIN rows AS r ON r.before = w.id),
heads AS (SELECT w.*, NOT EXISTS (SELECT 1 FROM rows AS r WHERE r.before = w.id) AS is_head FROM walk AS w)
SELECT root, arg_max(id, format('{:09d}', depth) || id) FILTER (is_head) AS head, CAST(max(depth) FILTER (is_head) + 1 AS BIGINT) AS length, count(*) FILTER (is_head) AS n_heads, count(*) AS n FROM heads GROUP BY root
"""

QUERIES: dict[str, Entry] = {
    "rarity_rank_top4": (rarity_rank_top4, _RANK),
    "rank_confidence_gated": (rank_confidence_gated, _GATED),
    "rank_cases": (rank_cases, _RANK_CASES),
    "contradiction_penalty": (contradiction_penalty, _PENALTY),
    "adjudicate_users": (adjudicate_users, _ADJUDICATE),
    "evidence_score_order": (evidence_score_order, _EVIDENCE),
    "evidence_resolve_shared": (evidence_resolve_shared, _SHARED),
    "frame_sampler": (frame_sampler, _FRAMES),
    "revision_chains": (revision_chains, _CHAINS),
    "latest_unsuperseded": (latest_unsuperseded, _LATEST),
}
