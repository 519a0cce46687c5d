"""What file paths of an archive of plant pictures tell: plant, group, class, split, and the role of a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders, names and notes of the archive.
DATASET, GROWTH, STRESS, PARTS = "DS-090", "Hemp_growth", "Hemp_water_stress", ("train", "test")
UNKNOWN, MODEL_FILE, MODEL_GROUP = "UNKNOWN", "yolo11x-cls.pt", "DS090-PUBLISHED-MODEL"
SOURCE_ROLE, MODEL_ROLE = "source-data", "published-model-reproducibility-only"
KEEP_TOGETHER = "All frames from this plant/time-series must remain in one split."
REGROUP = "Published train/test assignment is source metadata only; regroup by plant/time-series before our split."
NO_TRUTH = "Never use these weights or their outputs as ground-truth training/evaluation data."


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def plant(path: Column) -> Column:
    """C1 to C5 from the file's name, else from its folder of growth pictures, else UNKNOWN; capitals."""
    named = F.regexp_extract(base_name(path), r"(?i)(?:^|_)(C[1-5])(?:_|\.)", 1)
    folder = F.regexp_extract(path, rf"^{GROWTH}/((?i:C[1-5]))(?:/|$)", 1)
    full = lambda c: F.when(c != "", F.upper(c))
    return F.coalesce(full(named), full(folder), F.lit(UNKNOWN))


def source_class(path: Column) -> Column:
    """The published class: growth series, the folder below the published split, or empty."""
    deep = F.regexp_extract(path, rf"^{STRESS}/(?:{'|'.join(PARTS)})/([^/]*)/", 1)
    return F.when(path.startswith(f"{GROWTH}/"), "temporal-growth").otherwise(deep)


def source_split(path: Column) -> Column:
    return F.when(path.startswith(f"{STRESS}/train/"), "publisher-train").when(path.startswith(f"{STRESS}/test/"), "publisher-test").otherwise("growth-series")


def group_id(plant_id: Column) -> Column:
    return F.concat(F.lit("DS090-"), plant_id)


def inventory(path: Column) -> Column:
    """(group, source_class, role, eligible, notes) of a file in the inventory; published weights are never eligible."""
    parts = F.split(path, "/")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit("unknown"))
    grown, stressed, model = path.startswith(f"{GROWTH}/"), F.lit(False), path.endswith(MODEL_FILE)
    for p in PARTS:
        stressed = stressed | path.startswith(f"{STRESS}/{p}/")
    name = base_name(path)
    named = F.when(name.startswith("ryb_C") & (F.length(name) >= 6), F.get(F.split(name, "_"), F.lit(1))).otherwise("unknown")
    owner = F.when(grown, part(1)).when(stressed, named)
    return F.struct(
        F.when(model, MODEL_GROUP).when(owner.isNotNull(), group_id(owner)).otherwise("").alias("group"),
        F.when(model, "model").when(grown, "temporal-growth").when(stressed, part(2)).otherwise("").alias("source_class"),
        F.when(model, MODEL_ROLE).otherwise(SOURCE_ROLE).alias("role"), (~model).alias("eligible"),
        F.when(model, NO_TRUTH).when(grown, KEEP_TOGETHER).when(stressed, REGROUP).otherwise("").alias("notes"))
