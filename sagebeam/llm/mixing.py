"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key; the order by that key within a source is
the order in which the mix reads it.  Ranges of the key are buckets, so a source
of any size spreads over as many tasks as it needs; bucket sums and their prefix
sums per source give each document the words before it, and the source's budget
cuts there.  A budget above the source's size takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagebeam.llm.frames import fresh, stored

WEIGHTS = (5, 2, 1)
#: Times that a source may be repeated.
EPOCHS = 3
#: Rows of a bucket, on average; a bucket is sorted in one task.
BUCKET_ROWS = 2_000
_MOST_BUCKETS = 1 << 16
_SEED = "mix"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(doc_id: Column) -> Column:
    """16 hexadecimal digits, the same in every engine that has MD5."""
    return F.substring(F.md5(F.concat(F.lit(_SEED), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 16)


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) with target: shares of the total by weight, none above ``epochs`` times its size.

    Sources take the weights in turn by code point, null last.  Where a share is
    above the cap, the excess goes to the others by weight; this repeats until
    none is above, and each round caps at least one more source.  Only two
    numbers a round reach the driver.  Of sources there is a row each, so their
    order is a window over this small table.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    weighed, _ = stored(weighed.withColumn("cap", F.col("source_size") * float(epochs)), "mixing-sources")
    whole = float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") < F.col("weight") * level
        r = weighed.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("held"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("free"), F.sum(F.when(above, 1).otherwise(0)).alias("n")).first()
        if not r["free"] or r["n"] == capped:
            break
        capped, level = r["n"], max(level, (whole - r["held"]) / r["free"])
    return weighed.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, source: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken.

    size counts the text's words, source_size those of the source; target is the
    source's budget.  taken is the number of words that the mix takes from the
    document: size times the whole epochs, and once more for documents before
    the cut of the last epoch; the document at the cut gives the words that the
    budget still holds.  The taken words of a source are its target rounded to
    a whole number.

    Null and blank texts have size 0 and give nothing.  A null source is a source
    of its own, the last.  A null doc_id has a key like any other.  Ties of the
    key and repeated rows are ordered by size and then get equal parts of the
    order, so the sums stay right and reruns agree.  An empty table gives an
    empty result.  Only the named columns are read, so extra ones cannot clash.
    With ``source`` the row's source comes along under this name.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(F.col("doc_id")).alias("key"))
    sized, _ = stored(sized, "mixing-sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goals, _ = stored(targets(totals.drop("rows"), weights, epochs), "mixing-targets")
    most = totals.agg(F.max("rows")).first()[0] or 1
    bits = min(_MOST_BUCKETS.bit_length() - 1, max(0, (-(-most // BUCKET_ROWS) - 1).bit_length()))
    # The leading bits of the key number its range.
    bucket = F.shiftright(F.conv(F.substring("key", 1, 4), 16, 10).cast("int"), 16 - bits)
    dealt = sized.withColumn("bucket", bucket)
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("own")).withColumn("before", F.coalesce(F.sum("own").over(by_source), F.lit(0)))
    goal = F.round("target").cast("long")
    starts = sums.join(goals, sums.source.eqNullSafe(goals.source)).select(sums.source.alias("s"), F.col("bucket").alias("b"), "before", "source_size", "target", goal.alias("goal"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("epochs", F.least(whole, F.lit(epochs)).cast("long")).withColumn("rest", F.col("goal") - F.col("epochs") * F.col("source_size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("ahead")))
    own = [F.col("source").alias(source)] if source else []
    return placed.select("doc_id", *own, "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with the column ``taken`` (a fresh name if it is there).

    Rows are matched by doc_id, source and size; of rows that agree in all three,
    each takes the mean share, rounded up.  Rows that the mix takes nothing of,
    those without words among them, are left out; an empty table stays empty.
    """
    plan = mix_plan(docs, weights, epochs, "_mix_source").groupBy(F.col("doc_id").alias("_mix_id"), "_mix_source", F.col("size").alias("_mix_size")).agg(F.ceil(F.avg("taken")).alias("_mix_taken"))
    rows = docs.withColumn("_mix_words", word_count(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("_mix_id")) & F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_words") == F.col("_mix_size"))
    kept = rows.join(plan.where("_mix_taken > 0"), same)
    return kept.withColumn(fresh(docs, "taken"), F.col("_mix_taken").cast("long")).drop("_mix_id", "_mix_source", "_mix_size", "_mix_words", "_mix_taken")
