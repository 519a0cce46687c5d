"""Chains of revisions: which analysis stands at the end of those that supersede each other, and how long the chain is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebeam.operators.shared import stored


def lineage(rows: DataFrame, own: str, supersedes: str, circles: bool = False) -> DataFrame:
    """(id, root, depth, is_head) of revisions: root is the first of the chain, depth the steps back to it, is_head whether nothing supersedes the row.

    By pointer jumping: each round, what a row points to points on for it, so that a
    chain of n rows takes log2(n) rounds, each one join and one small job; rows
    that have reached their root take no part any more.  A row whose predecessor is
    null or not there is a root.  Ids must be unique and may be of any type that can
    be joined.  A circle stops the job, or with ``circles`` its rows, and those that
    lead into it, are left out.
    """
    nodes = rows.select(F.col(own).alias("id"), F.col(supersedes).alias("before"))
    known = nodes.where("id is not null").select(F.col("id").alias("known"))
    linked = nodes.join(known, F.col("before") == F.col("known"), "left")
    start = stored(linked.select("id", F.coalesce("known", "id").alias("to"), F.when(F.col("known").isNull(), 0).otherwise(1).cast("long").alias("steps")), "revisions-start")
    most = start.count()
    done, active, rounds = start.where("steps = 0"), start.where("steps > 0"), 0
    while active.limit(1).count():
        if 1 << rounds > 2 * most:
            if circles:
                break
            raise ValueError("revisions supersede each other in a circle")
        rounds += 1
        pointed = active.withColumn("there", F.lit(False)).unionByName(done.withColumn("there", F.lit(True))).select(F.col("id").alias("at"), F.col("to").alias("next"), F.col("steps").alias("more"), "there")
        jumped = stored(active.join(pointed, F.col("to") == F.col("at")).select("id", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), "there"), "revisions-round")
        # A row that has arrived points to its root and is looked up by those behind it.
        done, active = done.unionByName(jumped.where("there").drop("there")), jumped.where("not there").drop("there")
    found = done.select("id", F.col("to").alias("root"), F.col("steps").alias("depth"))
    followed = nodes.where("before is not null").select(F.col("before").alias("id")).distinct().withColumn("followed", F.lit(True))
    return found.join(followed, "id", "left").select("id", "root", "depth", F.col("followed").isNull().alias("is_head"))


def chains(rows: DataFrame, own: str, supersedes: str) -> DataFrame:
    """(root, head, length, n_heads, n) of every chain: head is the deepest row that nothing supersedes, of equally deep ones the largest id, length the rows from root to head, n_heads the rows that nothing supersedes and n all rows of the chain."""
    return lineage(rows, own, supersedes).groupBy("root").agg(
        F.max(F.when(F.col("is_head"), F.struct("depth", "id"))).alias("h"), F.count_if("is_head").alias("n_heads"), F.count("*").alias("n")).select(
        "root", F.col("h.id").alias("head"), (F.col("h.depth") + 1).alias("length"), "n_heads", "n")
