"""What a sample of annotation files looks like: tokens of lines, shares of numeric and of box-like lines, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Lines of the sample, examples and their characters.
SAMPLE, EXAMPLES, SHOWN = 5000, 20, 200
#: Files that are looked at first; twice as many each time their lines are too few.
FILES = 256
_BLANK = r"\s\x1C-\x1F\x85\xA0  -     　"
_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"
_NUMBER = r"(?i)[+-]?(?:(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:e[+-]?\d(?:_?\d)*)?|inf|infinity|nan)"


def lines_of(text: Column) -> Column:
    """The lines of a text, by any kind of line end, each without blanks around it."""
    return F.transform(F.split(text, _ENDS), lambda line: F.regexp_replace(line, f"^[{_BLANK}]+|[{_BLANK}]+$", ""))


def tokens_of(line: Column) -> Column:
    return F.split(line, f"[{_BLANK}]+")


def is_number(token: Column) -> Column:
    """Whether a token reads as a decimal number, an infinity or no number, single underscores between digits allowed."""
    return F.regexp_like(token, F.lit(f"^(?:{_NUMBER})$"))


def _value(token: Column) -> Column:
    plain = F.regexp_replace(F.lower(token), "_", "")
    return F.when(F.contains(plain, F.lit("inf")), F.lit(float("inf")) * F.when(F.startswith(plain, F.lit("-")), -1).otherwise(1)).when(F.contains(plain, F.lit("nan")), F.lit(float("nan"))).otherwise(plain.try_cast("double"))


def is_box(tokens: Column) -> Column:
    """Five numbers, the first at least 0 and the others between 0 and 1."""
    # No number is larger than any other here, so it is ruled out by the upper bound.
    first = _value(F.get(tokens, F.lit(0)))
    rest = F.forall(F.slice(tokens, 2, 4), lambda x: (_value(x) >= 0) & (_value(x) <= 1))
    return (F.size(tokens) == 5) & F.forall(tokens, is_number) & ~F.isnan(first) & (first >= 0) & rest


def sampled(files: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(path, at, line): the first ``most`` lines that are not blank of ``files`` (path, text), in the order of names and lines.

    Only as many files are looked at as hold them: files' counts, then prefix sums
    over at most ``most`` files, as each counts a line at least.
    """
    lines = files.select("path", F.posexplode(lines_of(F.coalesce("text", F.lit("")))).alias("at", "line")).where("line <> ''")
    counts = lines.groupBy("path").agg(F.count("*").alias("n")).orderBy("path").limit(most)
    before = F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = counts.withColumn("before", before).where(F.col("before") < most).select("path", "before")
    rank = F.row_number().over(Window.partitionBy("path").orderBy("at"))
    own = lines.join(F.broadcast(wanted), "path").withColumn("rank", rank).where(F.col("rank") <= most)
    return own.where(F.col("before") + F.col("rank") <= most).select("path", "at", "line")


def profile(lines: DataFrame, n_files: int | None = None) -> DataFrame:
    """(what, at, n, text) of sampled ``lines`` (path, at, line): the number of lines (``sampled``), of numeric ones, of box-like ones (``yolo5``), of each number of ``tokens``, and the first lines as ``example``."""
    tokens = tokens_of(F.col("line"))
    numeric = F.forall(tokens, is_number)
    marked = lines.select("path", "at", "line", F.size(tokens).alias("tokens"), numeric.alias("numeric"), is_box(tokens).alias("box"))
    by = marked.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("numeric").alias("numeric"), F.count_if("box").alias("box"))
    none = F.lit(None).cast("string")
    total = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sampled"), F.coalesce(F.sum("numeric"), F.lit(0)).alias("numeric"), F.coalesce(F.sum("box"), F.lit(0)).alias("yolo5"))
    whole = total.select(F.inline(F.array(*[F.struct(F.lit(k).alias("what"), F.lit(0).cast("long").alias("at"), F.col(k).cast("long").alias("n"), none.alias("text")) for k in ("sampled", "numeric", "yolo5")])))
    each = by.select(F.lit("tokens").alias("what"), F.col("tokens").cast("long").alias("at"), "n", none.alias("text"))
    # The window is over the few rows that the limit leaves.
    first = lines.orderBy("path", "at").limit(EXAMPLES)
    shown = first.select(F.lit("example").alias("what"), (F.row_number().over(Window.orderBy("path", "at")) - 1).cast("long").alias("at"), F.lit(None).cast("long").alias("n"), F.substring("line", 1, SHOWN).alias("text"))
    return whole.unionByName(each).unionByName(shown)


def read_sample(spark: SparkSession, path: str, ending: str = ".txt", most: int = SAMPLE) -> DataFrame:
    """``sampled`` lines of the files below ``path`` with this ending; files beyond those that hold them are not read.

    The first ``FILES`` names are read, and twice as many each time that they hold fewer lines.
    """
    named = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.endswith(F.col("path"), F.lit(ending))).select("path")
    total, n = named.count(), FILES
    while True:
        # At most as many names as lines are asked for are of use, blank files aside.
        names = [r["path"] for r in named.orderBy("path").limit(n).collect()]
        if not names:
            return spark.createDataFrame([], "path string, at int, line string")
        files = spark.read.option("wholetext", True).text(names).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        found = sampled(files, most)
        if n >= total or found.count() >= most:
            return found
        n *= 2
