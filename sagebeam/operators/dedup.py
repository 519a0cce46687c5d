"""Exact groups, near duplicates by Hamming distance, and their components."""

from __future__ import annotations

import tempfile
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sagebeam.functions import text as T

#: Values of a difference hash's picture, and its bits.
SLICES, BITS = 72, 64
#: Keys of words that one task of the join that finds edges sorts on each side, about.
KEYS_A_TASK = 1 << 19
#: Share of all edges beyond which a node is hot.
HOT = 1e-4


def _checkpoints(spark: SparkSession) -> None:
    """See that the context has a checkpoint folder: the one that the session names, else, in a local session alone, one of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sagebeam-checkpoint-"))


@F.pandas_udf(LongType())
def text_dhash(texts: pd.Series) -> pd.Series:
    """A 64-bit difference hash of a text of any length, as ``functions.text.dhash`` of its slices' sums of code points; null for null.

    Character i of n is in slice i * SLICES // n, so that every character counts and short texts leave slices at 0.
    """

    def word(text: str | None) -> int | None:
        if text is None:
            return None
        total = np.concatenate([[0], np.cumsum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), dtype=np.int64)])
        rows = np.diff(total[-(-np.arange(SLICES + 1) * (len(total) - 1) // SLICES)]).reshape(8, 9)
        return int.from_bytes(np.packbits(rows[:, :-1] > rows[:, 1:]).tobytes(), "big", signed=True)

    return pd.Series([word(t) for t in texts], dtype="Int64")


def exact_groups(rows: DataFrame, content: str, member: str) -> DataFrame:
    """(digest, n, first) of contents that more than one row has; counted before the shuffle."""
    return rows.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n"), F.min(member).alias("first")).where("n > 1")


def cross_class(rows: DataFrame, content: str, label: str) -> DataFrame:
    """(digest, n, labels) of repeated contents that stand under more than one label."""
    grouped = rows.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n"), F.countDistinct(label).alias("labels"))
    return grouped.where("n > 1 and labels > 1")


def members_of(rows: DataFrame, content: str, member: str) -> DataFrame:
    """(digest, n, member) for every row of a repeated content: member lists as rows, so that no group has to fit a task."""
    keyed = rows.select(F.sha2(F.col(content).cast("binary"), 256).alias("digest"), F.col(member).alias("member"))
    return keyed.join(keyed.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "digest").select("digest", "n", "member")


def hamming_classes(rows: DataFrame, member: str, bits: str) -> tuple[DataFrame, DataFrame]:
    """Rows by class of equal words, and one row per class: (member, word) and (word, first, n); words are made once."""
    _checkpoints(rows.sparkSession)
    members = rows.where(F.col(bits).isNotNull()).select(F.col(member).alias("member"), F.col(bits).alias("word")).checkpoint()
    return members, members.groupBy("word").agg(F.min("member").alias("first"), F.count("*").alias("n")).checkpoint()


def _bands(words: int, radius: int) -> int:
    """Into how many bands words are cut: the fewest whose keys, of all but ``radius`` bands, tell so many random words apart."""
    return next((m for m in range(radius + 1, 2 * radius) if words <= 1 << BITS * (m - radius) // m), 2 * radius)


def hamming_edges(classes: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b, distance) of the different words, a before b, at most ``radius`` bits apart.

    Of m disjoint bands two such words agree on at least m - radius, so equi-joins on
    every choice of that many bands find all pairs; the more words there are, the
    more bands, up to 70 keys of 32 bits at a radius of 4.  A pair is kept at the
    first bands that it agrees on, so none comes twice.  Words are distinct, whatever
    the number of their copies.
    """
    words = classes.count()
    m = _bands(words, radius)
    cuts = [BITS * i // m for i in range(m + 1)]
    widths = [hi - lo for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]

    def band(word: Column, i: int) -> Column:
        return F.shiftrightunsigned(word, cuts[i]).bitwiseAND(F.lit((1 << widths[i]) - 1))

    chosen = list(combinations(range(m), m - radius))
    keys = []
    for c in chosen:
        key, at = F.lit(0).cast("long"), 0
        for i in c:
            key = key.bitwiseOR(F.shiftleft(band(F.col("word"), i), at))
            at += widths[i]
        keys.append(key)
    split = classes.select("word", F.posexplode(F.array(*keys)).alias("choice", "key"))
    # So many tasks that what each sorts is bounded, whatever the session's number of partitions.
    split = split.repartition(max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words * len(chosen) // KEYS_A_TASK)), "choice", "key")
    pairs = split.alias("x").join(split.alias("y"), (F.col("x.choice") == F.col("y.choice")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.word") < F.col("y.word")))
    differ = F.col("x.word").bitwiseXOR(F.col("y.word"))
    distance = T.hamming(F.col("x.word"), F.col("y.word"))
    agreed = F.lit(0)
    for i in range(m):
        agreed = agreed + F.when(band(differ, i) == 0, 1 << i).otherwise(0)
    place = {sum(1 << i for i in c): k for k, c in enumerate(chosen)}
    firsts = [place.get(sum(1 << i for i in [i for i in range(m) if mask >> i & 1][: m - radius]), -1) for mask in range(1 << m)]
    first = F.get(F.array(*[F.lit(v) for v in firsts]), agreed)
    return pairs.where((distance <= radius) & (first == F.col("x.choice"))).select(F.col("x.word").alias("a"), F.col("y.word").alias("b"), distance.alias("distance"))


def edge_counts(rows: DataFrame, member: str, bits: str, label: str, radius: int = 4) -> DataFrame:
    """One row: pairs of rows at most ``radius`` bits apart (``edges``), and those under two labels (``cross_edges``).

    Counted by classes of equal words and their labels, so that copies are never paired.
    """
    _checkpoints(rows.sparkSession)
    labelled = rows.where(F.col(bits).isNotNull()).groupBy(F.col(bits).alias("word"), F.col(label).alias("label")).agg(F.count("*").alias("n")).checkpoint()
    classes = labelled.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    within = classes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("edges"), F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2).alias("cross"))
    edges = hamming_edges(classes.select("word"), radius)
    sized = lambda side: classes.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"))
    between = edges.join(sized("a"), "a").join(sized("b"), "b")
    of = lambda side: labelled.select(F.col("word").alias(side), "label", F.col("n").alias(f"n_{side}"))
    alike = edges.join(of("a"), "a").join(of("b"), ["b", "label"]).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("alike"))
    apart = between.agg(F.sum(F.col("n_a") * F.col("n_b")).alias("pairs"))
    zero = F.lit(0)
    both = within.crossJoin(apart).crossJoin(alike)  # a row each
    return both.select((F.coalesce("edges", zero) + F.coalesce("pairs", zero)).cast("long").alias("edges"), (F.coalesce("cross", zero) + F.coalesce("pairs", zero) - F.coalesce("alike", zero)).cast("long").alias("cross_edges"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the undirected ``edges(a, b)``: root is the smallest node reachable.

    Minimum labels over edges, then the label of the label, until nothing moves;
    each round is checkpointed to the shared folder.  Nodes with more than ``HOT`` of
    all edges, which are fewer than its inverse, tell their labels by broadcast, so
    that no star is one task.
    """
    _checkpoints(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select("b", "a")).checkpoint()
    least = max(1000, int(both.count() * HOT))
    hot = both.groupBy(F.col("a").alias("node")).count().where(F.col("count") > least).select("node", F.lit(True).alias("hot")).checkpoint()
    marked = both.join(F.broadcast(hot.withColumnRenamed("node", "a")), "a", "left")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")).checkpoint()
    while True:
        told = F.broadcast(labels.join(F.broadcast(hot), "node").select(F.col("node").alias("a"), "root"))
        said = marked.where("hot").join(told, "a").unionByName(marked.where("hot is null").join(labels.withColumnRenamed("node", "a"), "a"))
        near = said.select(F.col("b").alias("node"), "root").unionByName(labels).groupBy("node").agg(F.min("root").alias("root"))
        over = labels.select(F.col("node").alias("root"), F.col("root").alias("over"))
        new = near.join(over, "root").select("node", F.least("root", "over").alias("root")).checkpoint()
        moved = new.join(labels.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        labels = new
        if not moved:
            return labels


def near_groups(rows: DataFrame, member: str, bits: str, radius: int = 4) -> DataFrame:
    """(member, group) for every member with a near or exact duplicate: group is the smallest member of its component."""
    members, classes = hamming_classes(rows, member, bits)
    edges = hamming_edges(classes, radius)
    roots = components(edges)
    named = classes.join(roots, classes.word == roots.node, "left").withColumn("root", F.coalesce("root", "word"))
    groups = named.groupBy("root").agg(F.min("first").alias("group"), F.sum("n").alias("size")).where("size > 1")
    return members.join(named.select("word", "root"), "word").join(groups, "root").select("member", "group", "size")
