"""Routing of records to lanes, admission blockers, and review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagebeam.functions import keywords
from sagebeam.functions import text as T

HOST_TERMS = ("cannabis", "hemp")

# Keywords of the lanes, asked in this order.
LANES = {
    "04_VIRUS_VIROID_MOLECULAR": ("hlvd", "viroid", "virus", "bctv", "curly-top", "curly top", "mosaic"),
    "05_SEX_REPRODUCTIVE_MORPHOLOGY": ("sex", "male", "female", "intersex", "hermaph", "flower-morph", "reproductive"),
    "03_PATHOGENS_AND_DISEASE": ("fusarium", "botrytis", "powdery", "mildew", "pythium", "septoria", "cercospora", "curvularia", "bipolaris", "rust", "sclerot", "diaporthe", "xanthomon", "damping", "rot", "mold", "pathogen"),
    "02_PESTS_AND_ARTHROPODS": ("mite", "aphid", "thrip", "whitefly", "caterpillar", "earworm", "leafhopper", "lygus", "stink", "beetle", "gnat", "arthropod"),
    "06_HEALTHY_DEVELOPMENTAL_HARD_NEGATIVES": ("healthy", "senescence", "varieg", "reveget", "foxtail", "fasciat", "polyploid", "development", "trichome", "maturity", "normal"),
    "07_ABIOTIC_ENVIRONMENTAL_STRESS": ("light", "heat", "cold", "drought", "waterlog", "underwater", "overwater", "wind", "edema", "phytotoxic", "herbicide", "mechanical", "vpd", "environment"),
    "01_NUTRIENT_AND_ROOTZONE": ("nitrogen", "phosph", "potassium", "calcium", "magnesium", "sulfur", "iron", "zinc", "manganese", "boron", "copper", "nutrient", "salinity", "root-zone", "rootzone", "ammonium"),
}
TRANSFER, GATED = "CROSS_CROP_TRANSFER", "EXPERT_ITEM_GATED"

# Wording that counts as strong confirmation, licenses that allow training, terms that make a figure worth panels.
STRONG = ("lab-confirmed", "controlled-nutrient", "controlled-pathogenicity", "controlled-infestation", "controlled-inoculation", "standardized-damage-scale", "pathogenicity", "molecular", "ploidy-confirmed", "genotype-linked")
LICENSES = ("CC BY 4.0", "CC BY 3.0", "CC BY 3.0 US", "CC BY", "Public domain (US federal government work)")
HIGH_VALUE = ("cannabis", "hemp", "deficien", "toxicity", "aphid", "mite", "fusarium", "botrytis", "powdery", "mildew", "pythium", "hlvd", "viroid", "virus", "bctv", "root", "rot", "intersex", "male", "female", "senescence", "light", "water", "salinity", "stress")


def first_lane(text: Column, lanes: dict[str, tuple[str, ...]], otherwise: str) -> Column:
    """The first lane of which ``text`` holds a keyword."""
    return F.coalesce(*[F.when(T.contains_any(text, terms), F.lit(lane)) for lane, terms in lanes.items()], F.lit(otherwise))


def lane(record: Column, host_context: Column, host_species: Column, hosts: tuple[str, ...] = HOST_TERMS) -> Column:
    """The lane of a record by its lower-case text and host fields; transfer and gated lanes come before keywords."""
    host, species = (F.lower(T.strip(F.coalesce(c, F.lit("")))) for c in (host_context, host_species))
    foreign = F.when((host != "") | (species != ""), TRANSFER).otherwise(GATED)
    return F.when(host.contains("cross-crop"), TRANSFER).when(host == "organism-only", GATED).when(~T.contains_any(record, hosts), foreign).otherwise(first_lane(record, LANES, GATED))


def routed(rows: DataFrame, record: str, host_context: str, host_species: str, hosts: tuple[str, ...] = HOST_TERMS, lanes: dict[str, tuple[str, ...]] = LANES) -> DataFrame:
    """``rows`` with ``lane``, as by ``lane``, and ``home``: whether the text names the own host.  However many keywords there are, a text is read once."""
    marked = rows.withColumn("_found", keywords.groups_in(F.col(record), [hosts, *lanes.values()]))
    home, found = F.array_contains("_found", 0), F.array_min(F.filter("_found", lambda g: g > 0))
    by_word = F.when(found.isNotNull(), F.get(F.array(*[F.lit(k) for k in lanes]), found - 1)).otherwise(GATED)
    host, species = (F.lower(T.strip(F.coalesce(F.col(c), F.lit("")))) for c in (host_context, host_species))
    foreign = F.when((host != "") | (species != ""), TRANSFER).otherwise(GATED)
    out = F.when(host.contains("cross-crop"), TRANSFER).when(host == "organism-only", GATED).when(~home, foreign).otherwise(by_word)
    return marked.withColumns({"lane": out, "home": home}).drop("_found")


def lane_counts(routed: DataFrame, lanes: DataFrame) -> DataFrame:
    """Rows of every lane of the dimension ``lanes(lane)``, those without any too."""
    return lanes.join(routed.groupBy("lane").agg(F.count("*").alias("n")), "lane", "left").select("lane", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def assert_kept_home(routed: DataFrame, text: str, hosts: tuple[str, ...] = HOST_TERMS) -> DataFrame:
    """``routed``, stopping at a record that names the own host and is in the transfer lane all the same, as one with a cross-crop host would be.

    The column ``home`` tells who names the host, where there is one, else ``text`` is searched.
    """
    home = F.col("home") if "home" in routed.columns else T.contains_any(F.col(text), hosts)
    wrong = (F.col("lane") == TRANSFER) & home
    return routed.where(F.when(wrong, F.raise_error(F.lit("a record of the own host is routed to transfer")).cast("boolean")).isNull())


def blockers(rules: list[tuple[Column, str]]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for rule, name in rules]))


def panel_blockers(hosts: tuple[str, ...] = HOST_TERMS) -> Column:
    """Blockers of a panel joined with its parent (columns parent_*)."""
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    # The names of the blockers.
    host = T.lineage(*[F.col(c) for c in ("host", "parent_host_species", "parent_host_context", "parent_caption", "parent_source_article")])
    confirmed = T.lineage(F.col("confirmation"), F.col("parent_confirmation"))
    return blockers([
        (~T.contains_any(host, hosts), "non_cannabis_or_unresolved_host"),
        (~F.coalesce(F.col("parent_license").isin(*LICENSES), F.lit(False)), "license_not_training_compatible"),
        (~F.col("parent_intended_use").eqNullSafe(F.lit("reference-only")), "unexpected_parent_use_state"),
        (~T.contains_any(confirmed, STRONG), "confirmation_not_strong_enough_for_causal_seed"),
        (full("embedded_panel_label"), "embedded_panel_label_shortcut_risk"),
        (F.coalesce(F.col("reference_only_class"), F.lit(False)) | F.lower("issue_slug").endswith("-reference"), "reference_only_or_unmaterialized_canonical_class"),
        (~full("source_group_id"), "missing_source_group"),
        (~full("sha256") | ~full("perceptual_hash"), "missing_hashes"),
    ])


def audit_panels(panels: DataFrame, parents: DataFrame) -> DataFrame:
    """``panels`` with blockers and candidate (none); a panel without its parent stops the job."""
    wide = parents.select(F.col("id").alias("parent_id"), *[F.col(c).alias(f"parent_{c}") for c in ("host_species", "host_context", "caption", "source_article", "confirmation", "license", "intended_use")], F.lit(True).alias("_has"))
    joined = panels.join(wide, "parent_id", "left")
    found = F.when(F.col("_has").isNull(), F.raise_error(F.concat(F.lit("no parent "), F.col("parent_id"))).cast("boolean"))
    return joined.where(found.isNull()).withColumn("blockers", panel_blockers()).withColumn("candidate", F.size("blockers") == 0).drop("_has")


# Blockers of a class by its number of independent groups.
CLASS_RULES = ((1, "no_panel_review_candidates"), (2, "fewer_than_two_independent_eligible_source_groups"), (3, "insufficient_independent_groups_for_train_validation_locked_eval_design"))


def review_classes(panels: DataFrame, label: str, group: str, eligible: str) -> DataFrame:
    """(label, panels, groups, eligible_groups, status, blockers): whether a class has groups enough for three independent parts."""
    known = F.when(F.col(group) != "", F.col(group))
    out = panels.groupBy(F.coalesce(F.col(label), F.lit("__missing__")).alias(label)).agg(F.count("*").alias("panels"), F.countDistinct(known).alias("groups"), F.countDistinct(F.when(F.col(eligible), known)).alias("eligible_groups"))
    out = out.withColumn("blockers", blockers([(F.col("eligible_groups") < n, name) for n, name in CLASS_RULES]))
    return out.withColumn("status", F.when(F.size("blockers") == 0, "independence_review_possible").otherwise("collection_required"))


def panel_status(panelled: Column, own_host: Column, organism_only: Column, high_value: Column) -> tuple[Column, Column]:
    """What a figure needs next, and its priority P0 to P2."""
    # The names of the states.
    status = (
        F.when(panelled, "panelized").when(own_host & ~organism_only & high_value, "panelization_review_required")
        .when(own_host, "reference_review_required").otherwise("not_cannabis_panel_priority"))
    return status, F.when(status == "panelization_review_required", "P0").when(status == "reference_review_required", "P1").otherwise("P2")


def file_notes(video: Column, size: Column, width: Column, height: Column, seconds: Column) -> Column:
    """What is wrong with an upload; an empty list is good, any note asks for review."""
    small = F.when(video, (width < 720) | (height < 480)).otherwise((width < 900) | (height < 700))
    return blockers([
        (size < 90_000, "small file"), (size > 18_000_000, "large file"), (video & (seconds > 30.5), "long video"), (small, "low resolution"),
        (~video & (F.greatest(width, height) / F.least(width, height) > 3), "extreme aspect ratio")])
