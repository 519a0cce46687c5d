"""Media and catalogue rows: what may be shown or trained on, errata, index rows, and candidates for keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagebeam.operators.validation import HOSTS, LICENSES

# Corrections of sources, asked in this order: a field, its wrong or telling value, and the fields that it sets.
SOURCE_ERRATA = (
    ("title", "Cannabis sativa as a Host of Rice Root Aphid (Hemiptera: Aphididae) in North America", {"url": "https://doi.org/10.1093/jipm/pmaa008", "doi": "10.1093/jipm/pmaa008", "publicationDate": "2020-07-20"}),
    ("doi", "10.3390/app9204432", {"organization": "Applied Sciences (Cockson et al.)"}),
    ("title", "Septoria cannabicola, a new species on Cannabis sativa from Japan", {"url": "https://doi.org/10.47371/mycosci.2023.1.004", "doi": "10.47371/mycosci.2023.1.004", "publicationDate": "2024-03-02"}),
)
# The correction of one record, and of its warnings that hold a phrase.
RECORD_ERRATA = {
    "downy-mildew-pseudoperonospora": {
        "category": "Oomycete pathogen",
        "summary": "A foliar oomycete disease of Cannabis. Angular chlorotic-to-brown lesions and dark underside sporulation are stronger clues than top-surface discoloration alone.",
    }
}
WARNING_ERRATA = {"downy-mildew-pseudoperonospora": ("temporary UI grouping", "Pseudoperonospora is an oomycete, not a true fungus; disease-management and diagnostic interpretation should preserve that distinction.")}
#: What stands in for a creator that is not named.
NO_CREATOR = "See required attribution and source article"


def displayable(permission: Column, status: Column) -> Column:
    return F.coalesce((permission == "permitted") & status.isin("approved-reference", "approved-training"), F.lit(False))


def trainable(eligible: Column, permission: Column) -> Column:
    return F.coalesce(eligible & (permission == "permitted"), F.lit(False))


def corrected(entries: Column, rules: tuple[tuple[str, str, dict[str, str]], ...] = SOURCE_ERRATA) -> Column:
    """An array of structs in which the first rule that an entry meets has set its fields; order and other fields stay."""

    def one(entry: Column) -> Column:
        out = entry
        for field, value, new in reversed(rules):
            fixed = entry
            for k, v in new.items():
                fixed = fixed.withField(k, F.lit(v))
            out = F.when(F.coalesce(entry[field] == value, F.lit(False)), fixed).otherwise(out)
        return out

    return F.transform(entries, one)


def corrected_records(records: DataFrame, slug: str, fields: dict[str, dict[str, str]] = RECORD_ERRATA, phrases: dict[str, tuple[str, str]] = WARNING_ERRATA, warnings: str = "warnings") -> DataFrame:
    """``records`` with fields of some slugs set, and warnings of theirs that hold a phrase replaced."""

    def replaced(entries: Column, phrase: str, text: str) -> Column:
        return F.transform(entries, lambda w: F.when(F.contains(w, F.lit(phrase)), F.lit(text)).otherwise(w))

    out = {}
    for name in records.columns:
        new = F.col(name)
        if name == warnings:
            for key, (phrase, text) in phrases.items():
                new = F.when(F.col(slug) == key, replaced(F.col(name), phrase, text)).otherwise(new)
        for key, values in fields.items():
            if name in values:
                new = F.when(F.col(slug) == key, F.lit(values[name])).otherwise(new)
        out[name] = new
    return records.select(*[c.alias(n) for n, c in out.items()])


def index_rows(profiles: DataFrame, core: DataFrame, key: str) -> DataFrame:
    """Index entries of ``profiles``: their scalar columns, the sizes of sources and media, the layer (core or supplemental, by the ids of ``core``) and the record's path."""
    known = core.select(F.col(key)).distinct().withColumn("_core", F.lit(True))
    plain = [f.name for f in profiles.schema if f.dataType.typeName() not in ("array", "struct", "map")]
    layer = F.when(F.col("_core"), "core").otherwise("supplemental")
    return profiles.join(known, key, "left").select(
        *plain, F.coalesce(F.size("sources"), F.lit(0)).cast("long").alias("source_count"), F.coalesce(F.size("media"), F.lit(0)).cast("long").alias("media_count"),
        layer.alias("source_layer"), F.lit("diagnostic-profile").alias("record_type"), F.concat(F.lit("data/profiles/"), F.col(key).cast("string"), F.lit(".json")).alias("path"))


def kept_candidates(media: DataFrame, hosts: tuple[str, ...] = HOSTS, licenses: tuple[str, ...] = LICENSES) -> DataFrame:
    """Permitted images under an allowed license at an allowed host, in the form of candidates; all other rows go."""
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    good = (F.col("mediaType") == "image") & (F.col("displayPermission") == "permitted") & (F.col("trainingPermission") == "permitted") & F.col("license").isin(*licenses) & (F.col("url") != "") & host.isin(*hosts)
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return media.where(good).select(
        "id", F.col("issueSlug").alias("issue_slug"), F.col("url").alias("image_url"), F.col("sourceUrl").alias("source_article"), F.coalesce(full("caption"), full("alt"), F.col("diagnosticLabel")).alias("caption"),
        F.coalesce(full("creator"), F.lit(NO_CREATOR)).alias("creator"), "license", F.lit("reference-only").alias("intended_use"), F.lit(False).alias("required_fetch"),
        F.col("sha256").alias("expected_sha256"), F.col("perceptualHash").alias("expected_perceptual_hash"))
