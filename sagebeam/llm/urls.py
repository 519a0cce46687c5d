"""URL filters: a blocked Bloom filter of listed URLs before an exact hash join, in DataFrame functions only.

What is listed are rules (host and path prefix) and canonical URLs.  Every URL
has a few keys by which an entry could name it: its host's suffixes with the
path prefixes of the lengths that rules have, and its canonical form.  Listed
keys set eight bits each in a block of 512, one in each of its eight words; the
filter is a table of such blocks, so that probing is an equi-join on the block's
number, and all of a key's bits are in one row.  Keys that pass meet the entries
in an exact join, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebeam.llm.frames import meet, stored

#: Rules: verdict, host and path prefix.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Words of host labels whose pages the query lists.
JUNK = ("casino", "pills", "adult", "spam", "bets", "ads")

WORDS = 8
#: Keys of a block: 512 / 24 is 21 bits a key, of which each sets eight (about one in five thousand others passes).
KEYS = 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, path without index page, ending and last slashes; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(path, r"(?s)(?:/index)?(?:\.html?)?/*\z", "")))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: str, word: int) -> Column:
    """The bit that the column ``key`` has in a word of its block, as a number with that bit."""
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 1), {6 * word}) & 63 as int))")


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the filter of the column ``key``, a row for each of ``blocks`` that has a key."""
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*[F.bit_or(_bit("key", i)).alias(f"w{i}") for i in range(WORDS)])


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) of rules."""
    whole = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]).cast("array<struct<verdict:string,host:string,path:string>>")
    return spark.range(1).select(F.inline(whole))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict and listed.

    A rule (verdict, host, path) fits its host and all subdomains where the path
    begins with the rule's; of those that fit, the one of the longest host and
    path together counts, at equal lengths that of the longer host.  rule is its
    host and path, else null, and verdict its verdict; without a rule, URLs whose
    canonical form is one of ``listed`` (url) are blocked and all others allowed.
    listed tells whether the canonical form is listed.

    A null URL, or one without ``://``, has empty host and path, no rule and no
    canonical form, and is allowed.  An empty path begins with no rule's ``/``.
    Repeated rows are rows like any others, null ids too.  Nulls in ``rules`` and
    ``listed`` are left out, repeats count once.  Either may be empty, and so may
    ``pages``.  Only the named columns are read, so extra ones cannot clash.
    """
    sound = rules.where("verdict in ('allow', 'block') and host <> '' and path is not null")
    # A key names the length of its host, because a rule's host may be cut from its path at one place only.
    key = F.concat(F.lit("r"), F.length("host"), F.lit(":"), "host", "path")
    # What an entry says is a number, larger for the rule that wins: length of the rule, length of its host, and one for block; 0 is a listed URL.
    says = F.shiftleft((F.length("host") + F.length("path")).cast("long"), 32) + 2 * F.length("host") + F.when(F.col("verdict") == "block", 1).otherwise(0)
    ruled = sound.groupBy(key.alias("key")).agg(F.max(says).alias("says"))
    own = F.concat(F.lit("u:"), canonical(F.col("host"), F.col("path")))
    marks = listed.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).select(own.alias("key")).where("key is not null").distinct()
    entries, _ = stored(ruled.unionByName(marks.withColumn("says", F.lit(0).cast("long"))), "urls-entries")
    n = entries.count()
    blocks = max(1, -(-n // KEYS))
    # Lengths of rules' paths: no more of them than a URL has characters.
    lengths = sorted(r[0] for r in sound.select(F.length("path")).distinct().collect())
    # The task that reads a row is part of its group's key, so that a row repeated without end stays with many tasks.
    rows, _ = stored(pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.spark_partition_id().alias("part")), "urls-pages")
    starts = F.filter(F.sequence(F.lit(1), F.length("host")), lambda i: (i == 1) | (F.substring("host", i - 1, F.lit(1)) == "."))
    cuts = F.filter(F.array(*[F.lit(k) for k in lengths]).cast("array<int>"), lambda k: k <= F.length("path"))
    prefixes = F.flatten(F.transform(starts, lambda i: F.transform(cuts, lambda k: F.concat(
        F.lit("r"), F.length("host") - i + 1, F.lit(":"), F.substring("host", i, F.length("host")), F.substring("path", F.lit(1), k)))))
    names = ["page_id", "host", "path", "part"]
    probes = rows.where("host <> ''").select(*names, F.explode(F.array_append(prefixes, own)).alias("key")).withColumn("block", _block(F.col("key"), blocks))
    passed = meet(probes, bloom(entries, blocks), "block", blocks, "urls-probes")
    for i in range(WORDS):
        passed = passed.where(F.col(f"w{i}").bitwiseAND(_bit("key", i)) != 0)
    hits = meet(passed.select(*names, "key"), entries, "key", n, "urls-passed")
    each = rows.select(*names, F.lit(1).alias("copies"), F.lit(-1).cast("long").alias("says"), F.lit(0).alias("listed"))
    said = hits.select(*names, F.lit(0).alias("copies"), "says", (F.col("says") == 0).cast("int").alias("listed"))
    told = each.unionByName(said).groupBy(*names).agg(F.sum("copies").alias("copies"), F.max("says").alias("says"), F.max("listed").alias("listed"))
    at = F.shiftright(F.col("says").bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int")
    whole = F.shiftright("says", 32).cast("int")
    rule = F.when(F.col("says") > 0, F.concat(F.substring("host", F.length("host") - at + 1, at), F.substring("path", F.lit(1), whole - at)))
    blocked = F.when(F.col("says") > 0, F.col("says").bitwiseAND(F.lit(1)) == 1).otherwise(F.col("listed") == 1)
    out = told.select("page_id", "host", "path", rule.alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"), (F.col("listed") == 1).alias("listed"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.drop("col")


def junk_pages(pages: DataFrame, words: tuple[str, ...] = JUNK) -> DataFrame:
    """The ``url`` of pages a label of whose host has one of ``words`` between its hyphens."""
    return pages.where(host(F.col("url")).rlike(rf"(?:^|[.-])(?:{'|'.join(words)})(?:[.-]|$)")).select("url")
