"""Content gates as a table of rules, joined to what records say and judged by kind.

A record's fields are facets: rows of (record_id, scopes, field, items, number).  A
rule names a scope (a record, a category, all), a field, a kind and what it asks for.
Rules and facets meet by an equi-join, and one expression judges all kinds, so the
plan does not grow with the rules; the words that rules look for are found by
automata that read each text once for all rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebeam.functions import keywords

RULE = "rule string, scope string, field string, kind string, value string, number double"
#: Rules that are broadcast (about 200 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 200_000
#: Different words that automata are made for, on the driver; a table of more is refused.
MOST_TERMS = 200_000
#: Stands for a facet as a whole where it meets rules; the terms found in it have numbers from 0.
WHOLE = -1
#: What a rule may ask of a field: its text in lower case has the value, has it not, matches it; its text as it stands matches; its items have it, have none like it, one of them holds it; the first is it; how many there are; the number's ceiling.
KINDS = ("holds", "lacks", "matches", "matches_case", "lists", "none", "some", "is", "size", "least", "most")

# What the gates ask of the records of the catalogue, by slug.
_REVIEWED = ("reviewStatus", "is", "reviewed")
_UNTRAINED = ("media.trainingEligible", "none", "true")
_TISSUE, _PH_EC = ("confirmation", "matches", "tissue"), ("confirmation", "matches", "ph.*ec|ec.*ph")
_ROOT_ZONE, _BOTH_CANOPIES = ("confirmation", "matches", "root-zone.*ph.*ec"), ("confirmation", "matches", "upper- and lower-canopy foliage")
_NOT_UNIVERSAL, _SENESCENCE = ("warnings", "matches", "not universal|not.*universal"), ("lookAlikes", "lists", "Normal late-flower senescence")
RECORD_GATES: dict[str, tuple[tuple[str, str, str | float], ...]] = {
    "botrytis-gray-mold-bud-rot": (
        _REVIEWED, ("confirmation", "matches", "interior|internal"), ("confirmation", "matches", "laboratory"), ("warnings", "matches", "not species-level ground truth|not.*ground truth"),
        ("lookAlikes", "lists", "Fusarium flower mold or bud rot"), ("lookAlikes", "lists", "Normal pistil browning and late-flower senescence"), ("media.id", "size", 4), _UNTRAINED),
    "powdery-mildew": (
        _REVIEWED, ("photoOnlyMaxConfidence", "most", 0.6), ("scientificName", "matches_case", "Golovinomyces ambrosiae.*Podosphaera macularis"), ("confirmation", "holds", "do not assign a powdery-mildew species"),
        ("confirmation", "matches", "upper- and lower-surface|upper.*lower.*surface"), ("confirmation", "matches", "microscopy.*molecular testing"), ("confirmation", "holds", "symptom-negative"), ("warnings", "matches", "spadiceus.*ambrosiae"),
        ("warnings", "holds", "not species-level ground truth"), ("warnings", "holds", "not a universal field severity"), ("lookAlikes", "lists", "Foliar spray residue"), ("lookAlikes", "lists", "Glandular trichomes on floral tissue"),
        ("lookAlikes", "lists", "Spider-mite webbing"), ("lookAlikes", "lists", "Botrytis gray mold or bud rot"), ("lookAlikes", "lists", "Downy mildew"), ("sources.doi", "lists", "10.1094/PDIS-01-19-0049-PDN"),
        ("sources.doi", "lists", "10.1094/PHYTOFR-07-23-0099-R"), ("sources.doi", "lists", "10.3389/fagro.2021.720215"), ("sources.doi", "lists", "10.3389/fpls.2025.1543229")),
    "nitrogen-deficiency": (
        _REVIEWED, ("photoOnlyMaxConfidence", "most", 0.6), ("sources.doi", "lists", "10.3390/app9204432"), ("sources.doi", "lists", "10.3390/plants12030422"), ("confirmation", "matches", "upper- and lower-canopy|upper.*lower.*canopy"), _ROOT_ZONE,
        ("confirmation", "holds", "do not use one tissue number as a universal threshold"), ("warnings", "holds", "late-cycle yellowing is not nitrogen-deficiency ground truth"), ("warnings", "holds", "all symptom-only"),
        ("lookAlikes", "lists", "Normal late-flower leaf aging or senescence"), ("lookAlikes", "lists", "Magnesium deficiency"), ("lookAlikes", "lists", "Sulfur deficiency")),
    "phosphorus-deficiency": (
        _REVIEWED, _TISSUE, _PH_EC, ("confirmation", "matches", "root-zone|soil testing|substrate"), _NOT_UNIVERSAL, ("warnings", "matches", "purple.*not.*ground truth"), _SENESCENCE, ("media.id", "size", 1),
        ("media.0.useLimitations", "matches", "three diagnosis classes"), _UNTRAINED),
    "calcium-deficiency": (
        _REVIEWED, ("confirmation", "matches", "upper and lower canopy|upper/lower canopy"), ("confirmation", "matches", "source water"), _ROOT_ZONE, ("warnings", "matches", "disagreed.*canopy location|location alone is not ground truth"),
        ("warnings", "matches", "three.*plants per treatment"), ("lookAlikes", "lists", "Potassium deficiency"), ("lookAlikes", "lists", "Broad mite injury"), ("media.id", "size", 1), ("media.0.useLimitations", "matches", "temporal sequence"), _UNTRAINED),
    "iron-deficiency": (
        _REVIEWED, ("confirmation", "matches", "leaf tissue|tissue"), _PH_EC, ("warnings", "matches", "no visible.*symptom|symptom absence cannot rule out"), _NOT_UNIVERSAL, ("lookAlikes", "lists", "Manganese deficiency"),
        ("lookAlikes", "lists", "Light bleaching or heat stress"), ("media.id", "size", 1), ("media.0.useLimitations", "matches", "two diagnosis classes"), _UNTRAINED),
    "zinc-deficiency": (
        _REVIEWED, _TISSUE, _PH_EC, ("confirmation", "matches", "phosphorus"), ("warnings", "matches", "phosphorus.*may have caused|mechanism-specific"), ("warnings", "matches", "symptom absence cannot exclude"), ("lookAlikes", "lists", "Iron deficiency"),
        ("lookAlikes", "lists", "Phosphorus toxicity or phosphorus-zinc interaction"), ("media.id", "size", 1), ("media.0.useLimitations", "matches", "five columns.*distinct zinc treatments"), _UNTRAINED),
    "sulfur-deficiency": (
        _REVIEWED, ("confirmation", "matches", "upper- and lower-canopy|upper.*lower.*canopy"), _TISSUE, _PH_EC, ("warnings", "matches", "differed.*canopy location|canopy position alone"), ("warnings", "matches", "senescence"),
        ("lookAlikes", "lists", "Nitrogen deficiency"), _SENESCENCE, ("media.id", "size", 1), ("media.0.useLimitations", "matches", "four panels"), _UNTRAINED),
    "manganese-deficiency": (
        _REVIEWED, ("confirmation", "matches", "do not confirm or exclude"), _BOTH_CANOPIES, ("confirmation", "matches", "root-zone ph.*ec"), ("warnings", "matches", "no obvious visual symptoms"), ("warnings", "matches", "not.*universal threshold"),
        ("lookAlikes", "lists", "Iron deficiency"), ("lookAlikes", "lists", "Magnesium deficiency"), ("media.id", "size", 1), ("media.0.useLimitations", "matches", "three diagnosis classes"), _UNTRAINED),
    "copper-deficiency": (
        _REVIEWED, ("confirmation", "matches", "root-zone ph.*ec"), ("confirmation", "matches", "tissue|foliage"), ("warnings", "matches", "figure-number inconsistency"), ("warnings", "matches", "not universal thresholds"),
        ("warnings", "matches", "not image-only ground truth"), ("lookAlikes", "lists", "Broad mite injury"), ("lookAlikes", "lists", "Boron deficiency"), ("media.id", "size", 0)),
    "magnesium-deficiency": (
        _REVIEWED, _BOTH_CANOPIES, ("confirmation", "matches", "root-zone ph.*ec"), ("warnings", "matches", "differed in later leaf-age distribution"), ("warnings", "matches", "not.*universal threshold"), ("lookAlikes", "lists", "Potassium deficiency"),
        _SENESCENCE, ("media.id", "size", 2), ("media.0.useLimitations", "matches", "three diagnosis classes"), ("media.1.useLimitations", "matches", "five panels mix"), _UNTRAINED),
    "potassium-deficiency": (
        _REVIEWED, ("confirmation", "matches", "fan- and sugar-leaf tissue"), ("confirmation", "matches", "root-zone ph.*ec"), ("warnings", "matches", "differed in stage, onset time, and early tissue presentation"), ("warnings", "matches", "not.*universal threshold"),
        ("lookAlikes", "lists", "High-EC nutrient burn or salinity"), ("lookAlikes", "lists", "Boron toxicity"), ("media.id", "size", 1), ("media.0.useLimitations", "matches", "sugar-leaf and fan-leaf"), _UNTRAINED),
    "overwatering-root-hypoxia": (
        _REVIEWED, ("confirmation", "matches", "container weight|substrate-water|standing water"), ("confirmation", "matches", "laboratory"), ("warnings", "matches", "image-only|photograph.*cannot"), ("lookAlikes", "lists", "Water shortage or drought"),
        ("lookAlikes", "matches_case", "Pythium")),
    "acidic-extreme-substrate-ph-stress": (
        _REVIEWED, ("confirmation", "matches", "actual substrate|root-zone ph"), ("confirmation", "matches", "calibrated meter"), ("confirmation", "matches", "alkalinity"), ("confirmation", "matches", "ec"),
        ("warnings", "matches", "not a universal image phenotype|not.*universal.*image"), ("warnings", "matches", "peat-based.*not.*soil.*coco.*rockwool"), ("warnings", "matches", "fourfold micronutrients"),
        ("lookAlikes", "lists", "Waterlogging or root-zone hypoxia"), ("lookAlikes", "matches_case", "Pythium"), ("media.id", "size", 0)),
    "two-spotted-spider-mites": (
        _REVIEWED, ("scientificName", "is", "Tetranychus urticae"), ("photoOnlyMaxConfidence", "most", 0.55), ("confirmation", "matches", "do not confirm.*image or video alone"), ("confirmation", "holds", "lower-leaf"), ("confirmation", "holds", "10x"),
        ("confirmation", "holds", "white paper"), ("confirmation", "matches", "entomologist|diagnostic-laboratory"), ("warnings", "holds", "two hemp cultivars"), ("warnings", "holds", "observational study reference"),
        ("warnings", "holds", "no research-based action threshold"), ("warnings", "holds", "not species-level ground truth"), ("lookAlikes", "lists", "Thrips"), ("lookAlikes", "lists", "Hemp russet mites"), ("lookAlikes", "lists", "Predatory mites"),
        ("lookAlikes", "lists", "Nutrient or root-zone stress"), ("sources.doi", "lists", "10.3390/agronomy16060651"), ("sources.url", "some", "ncsu.edu/twospotted-spider-mite")),
    "cannabis-reproductive-sex-expression": (
        ("warnings", "matches", "seedling.*not reliable|seedling.*not.*ground-truth"), ("confirmation", "matches", "reproductive|stigma|anther"), ("confirmation", "matches", "repeat inspection|serial"), ("warnings", "matches", "chromosomal sex|genetic")),
}
# What the gates ask of all records of a category.
CATEGORY_GATES: dict[str, tuple[tuple[str, str, str | float], ...]] = {
    "Bacterial pathogen": (("confirmation", "holds", "laboratory"), ("warnings", "matches", "photograph|image|video"), ("warnings", "matches", "cannot confirm|not.*ground-truth")),
    "Phytoplasma / Spiroplasma": (("confirmation", "matches", "laboratory|molecular"), ("warnings", "matches", "image-only|visual diagnosis|not a species-level"), ("lookAlikes", "lists", "Beet curly top virus disease")),
}


def catalogue_rules(spark: SparkSession) -> DataFrame:
    """The gates above as a rule table."""
    rows = []
    for prefix, gates in (("slug", RECORD_GATES), ("category", CATEGORY_GATES)):
        for name, asked in gates.items():
            rows += [(f"{name}: {field} {kind} {want}", f"{prefix}:{name}", field, kind, None if isinstance(want, (int, float)) else want, float(want) if isinstance(want, (int, float)) else None) for field, kind, want in asked]
    return spark.createDataFrame(rows, RULE)


def catalogue_facets(records: DataFrame) -> DataFrame:
    """Facets of catalogue records: slug, category, reviewStatus, scientificName, photoOnlyMaxConfidence, arrays confirmation, warnings and lookAlikes, and arrays of structs media (id, trainingEligible, useLimitations) and sources (doi, url)."""
    nothing = F.expr("cast(array() as array<string>)")
    one = lambda c: F.array_compact(F.array(F.col(c)))
    # A medium's wording is a facet of its own, by its place.
    limits = F.transform(F.col("media"), lambda m, i: F.struct(F.concat(F.lit("media."), i, F.lit(".useLimitations")).alias("field"), m["useLimitations"].alias("items"), F.lit(None).cast("double").alias("number")))
    facet = lambda field, items, number=None: F.struct(F.lit(field).alias("field"), items.alias("items"), (F.lit(None).cast("double") if number is None else number.cast("double")).alias("number"))
    whole = F.array(
        *[facet(c, one(c)) for c in ("reviewStatus", "scientificName")], *[facet(c, F.col(c)) for c in ("confirmation", "warnings", "lookAlikes")], facet("photoOnlyMaxConfidence", nothing, F.col("photoOnlyMaxConfidence")),
        facet("media.id", F.col("media.id")), facet("media.trainingEligible", F.transform("media", lambda m: m["trainingEligible"].cast("string"))),
        *[facet(f"sources.{k}", F.array_compact(F.col(f"sources.{k}"))) for k in ("doi", "url")])
    scopes = F.array(F.concat(F.lit("slug:"), "slug"), F.concat(F.lit("category:"), "category"), F.lit("all"))
    return records.select(F.col("slug").alias("record_id"), F.array_compact(scopes).alias("scopes"), F.inline(F.concat(whole, F.coalesce(limits, F.array().cast("array<struct<field:string,items:array<string>,number:double>>")))))


def _met(kind: Column, value: Column, asked: Column) -> Column:
    n = F.size("items")
    text = F.array_join("items", " ")
    return (
        F.when(kind == "holds", F.array_contains("found", F.col("term"))).when(kind == "lacks", ~F.array_contains("found", F.col("term")))
        .when(kind == "matches", F.rlike(F.col("text"), value)).when(kind == "matches_case", F.rlike(text, value)).when(kind == "lists", F.array_contains("items", value))
        .when(kind == "none", ~F.array_contains("items", value)).when(kind == "some", F.exists("items", lambda x: F.contains(x, value))).when(kind == "is", F.get("items", F.lit(0)) == value)
        .when(kind == "size", n == asked).when(kind == "least", n >= asked).when(kind == "most", F.col("number") <= asked)
        .otherwise(F.raise_error(F.concat(F.lit("no such kind of rule: "), kind)).cast("boolean")))


def violations(facets: DataFrame, rules: DataFrame) -> DataFrame:
    """(record_id, rule, scope) for every facet and rule of its scope and field that it does not meet.

    A rule about a record (scope ``slug:...``) of which there is no such facet is
    violated too, with a null record_id; rules about categories or all records
    ask nothing where there are none.  Null items are no items; a number that is
    missing is below no ceiling.  An unknown kind stops the job.
    """
    spark = facets.sparkSession
    of_terms = rules.where("kind in ('holds', 'lacks') and value is not null")
    terms = [r[0] for r in of_terms.select("value").distinct().orderBy("value").limit(MOST_TERMS + 1).collect()]
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} different terms")
    # Only fields that a rule asks for terms are read by the automata.
    read = F.broadcast(of_terms.select("field").distinct().withColumn("read", F.lit(True)))
    ready = facets.join(read, "field", "left").withColumn("items", F.array_compact(F.coalesce("items", F.expr("cast(array() as array<string>)")))).withColumn("text", F.lower(F.array_join("items", " ")))
    ready = ready.withColumn("terms_of", F.when(F.col("read"), F.col("text")))
    ready = keywords.with_terms(ready, "terms_of", terms, "found") if terms else ready.withColumn("found", F.expr("cast(array() as array<int>)"))
    numbered = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "value string, term int")
    asked = rules.join(F.broadcast(numbered), "value", "left").select("rule", "scope", F.col("field").alias("of"), "kind", "value", F.col("number").alias("asked"), "term")
    # A rule that a text lacks a term meets the term where it was found, and so only what violates it; all other rules meet the facet itself.
    asked = asked.withColumn("met_by", F.when((F.col("kind") == "lacks") & F.col("term").isNotNull(), F.col("term")).otherwise(WHOLE))
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    of_whole = lambda c: F.when(F.col("by") == WHOLE, F.col(c)).alias(c)
    placed = ready.select("record_id", F.explode("scopes").alias("at"), "field", "items", "number", "text", "found").withColumn("by", F.explode(F.concat(F.array(F.lit(WHOLE)), "found")))
    placed = placed.select("record_id", "at", "field", "by", "number", *[of_whole(c) for c in ("items", "text", "found")])
    met = placed.join(F.broadcast(asked) if small else asked, (F.col("at") == F.col("scope")) & (F.col("field") == F.col("of")) & (F.col("by") == F.col("met_by")))
    kept = F.when(F.col("by") == WHOLE, F.coalesce(_met(F.col("kind"), F.col("value"), F.col("asked")), F.lit(False))).otherwise(False)
    failed = met.where(~kept).select("record_id", "rule", "scope")
    own = asked.where("startswith(scope, 'slug:')")
    there = facets.select(F.explode("scopes").alias("at"), "field").where("startswith(at, 'slug:')").distinct()
    lost = own.join(there, (own["scope"] == there["at"]) & (own["of"] == there["field"]), "left_anti")
    return failed.unionByName(lost.select(F.lit(None).cast(facets.schema["record_id"].dataType).alias("record_id"), "rule", "scope"))
