"""Readers: JSON documents, JSON lines, file trees, archives, figures and links."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

IMAGES = ("jpg", "jpeg", "png", "tif", "tiff", "webp", "gif", "bmp")
ANNOTATIONS = ("json", "xml", "csv", "txt", "yaml", "yml")


def json_records(spark: SparkSession, path: str, schema: t.StructType, envelope: str | None = "records") -> DataFrame:
    """Records of whole-file JSON documents, below ``envelope`` or, with None, a top-level array."""
    reader = spark.read.option("multiLine", True)
    if envelope is None:
        return reader.schema(schema).json(path)
    whole = t.StructType([t.StructField(envelope, t.ArrayType(schema))])
    return reader.schema(whole).json(path).select(F.explode(envelope).alias("r")).select("r.*")


def indented_records(spark: SparkSession, path: str, schema: t.StructType, envelope: str | None = "records") -> DataFrame:
    """Records of JSON documents as ``sinks.write_json_document`` prints them, objects with a field at least: below ``envelope``, their last member, or, with None, of a top-level array.

    A string has no line break as it is, so the lines between two records, by their
    indent, are nowhere else in the array; files are split there like lines and
    ranges are read apart.  What is before the array is left out.
    """
    base = "  " if envelope is None else "    "
    open_ = "[\n" if envelope is None else f"{json.dumps(envelope, ensure_ascii=False)}: [\n"
    open_ = f"{'' if envelope is None else chr(10) + '  '}{open_}{base}{{\n"
    pieces = spark.read.option("lineSep", f"\n{base}}},\n{base}{{").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("at"), F.col("value").alias("piece"))
    heads = pieces.where(F.contains("piece", F.lit(open_))).groupBy("file").agg(F.min("at").alias("head"))
    found = pieces.join(F.broadcast(heads), "file").where("at >= head")  # a row a document
    body = F.when(F.col("at") == F.col("head"), F.substring_index("piece", open_, -1)).otherwise(F.col("piece"))
    body = F.regexp_replace(body, rf"\n{base}\}}\n{base[2:]}\](\n\}})?\n?$", "")
    return found.select(F.from_json(F.concat(F.lit("{"), body, F.lit("}")), schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def json_lines(spark: SparkSession, path: str, schema: t.StructType) -> tuple[DataFrame, DataFrame]:
    """The sound lines of JSON-lines files, and the broken ones as (file, line, content); empty lines are in neither.

    ``line`` numbers a file's lines that are not empty, from 1: a line's place in
    its block of the file, after the lines of the blocks before, which are counted
    block by block.  Blocks are read apart, so a file of any size is many tasks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("content")).where("content <> ''")
    lines = lines.withColumn("id", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parsed = lines.withColumn("r", F.from_json("content", t.StructType([*schema.fields, t.StructField("_broken", t.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    broken = parsed.where("r._broken is not null").join(blocks.withColumn("before", before), ["file", "block"])
    return parsed.where("r._broken is null").select(*[F.col(f"r.{f.name}") for f in schema.fields]), broken.select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "content")


def json_batches(spark: SparkSession, pattern: str, schema: t.StructType, key: str) -> DataFrame:
    """Records of all JSON arrays whose files match a glob, one per key: that of the last file by name, and in it the last."""
    rows = spark.read.option("multiLine", True).schema(schema).json(pattern).select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*[f.name for f in schema.fields]), F.struct("_file", "_at")).alias("r")).select("r.*")


def split_parts(files: DataFrame, size: int) -> DataFrame:
    """Files (path, content) cut into parts of at most ``size`` bytes: path, part (from 0), content, and the digests of part and file."""
    count = F.greatest(F.ceil(F.octet_length("content") / size), F.lit(1)).cast("int")
    cut = files.withColumn("whole", F.sha2("content", 256)).withColumn("part", F.explode(F.sequence(F.lit(0), count - 1)))
    own = F.substring(F.col("content"), F.col("part") * size + 1, F.lit(size))
    return cut.select("path", "part", own.alias("content"), F.sha2(own, 256).alias("sha256"), "whole")


def joined_parts(parts: DataFrame) -> DataFrame:
    """(path, content) of files from their parts, in order; a part or a file whose digest differs stops the job."""
    found = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "content", "sha256"))).alias("p"), F.first("whole").alias("whole"))
    content = F.aggregate("p", F.unhex(F.lit("")), lambda done, x: F.concat(done, x["content"]))
    sound = F.forall("p", lambda x: F.sha2(x["content"], 256) == x["sha256"]) & (F.sha2(content, 256) == F.col("whole"))
    wrong = F.when(~sound, F.raise_error(F.concat(F.lit("digests differ: "), F.col("path"))).cast("boolean"))
    return found.where(wrong.isNull()).select("path", content.alias("content"))


def file_tree(spark: SparkSession, path: str, extensions: tuple[str, ...] = IMAGES, content: bool = False) -> DataFrame:
    """Files below ``path`` with one of the endings, any case: path, length, and the bytes if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(ending.isin(*extensions)).select("path", "length", *(["content"] if content else []))


_ENTRY = "path string, member string, bytes long, packed long, crc32 long, is_image boolean, is_annotation boolean, is_zip boolean, depth int"


def zip_inventory(archives: DataFrame, nested: bool = True) -> DataFrame:
    """Members of zip archives (path, content), those of archives inside too; unsafe names are refused.

    Nothing is written: inner archives are opened in memory, one after the other.
    """

    def entries(path: str, data: bytes, depth: int) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if i.is_dir():
                    continue
                name = i.filename.replace("\\", "/")
                if name.startswith("/") or ".." in name.split("/") or name[1:2] == ":":
                    raise ValueError(f"{path}: unsafe member {i.filename}")
                ending = name.rpartition(".")[2].lower()
                yield path, name, i.file_size, i.compress_size, i.CRC, ending in IMAGES, ending in ANNOTATIONS, ending == "zip", depth
                if nested and ending == "zip":
                    yield from entries(f"{path}!{name}", z.read(i), depth + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _ENTRY.split(", ")]
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(list(entries(path, data, 0)), columns=names)

    return archives.select("path", "content").mapInPandas(run, _ENTRY)


def links(html: Column, pattern: str = r"https?://[^\s\"'<>]+") -> Column:
    """URLs of a page, in order and once each."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)))


def figure_links(xml: Column) -> Column:
    """(label, href) of the figures of an article: the number in each label and the file of its graphic."""
    figures = F.regexp_extract_all(xml, F.lit(r"(?s)<fig[\s>].*?</fig>"), F.lit(0))
    return F.transform(figures, lambda f: F.struct(F.regexp_extract(f, r"(?s)<label>[^<]*?(\d+)", 1).alias("label"), F.regexp_extract(f, r"""(?s)<graphic[^>]*?href=["']([^"']+)""", 1).alias("href")))


def pick_member(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (path, name): a member of that base name, else the largest whose name holds the stem."""
    base, stem = F.lower(F.regexp_extract("member", "([^/]+)$", 1)), F.lower(F.regexp_replace("name", r"\.[^.]+$", ""))
    both = members.join(wanted, "path").where((base == F.lower("name")) | F.contains(base, stem))
    best = F.struct((base == F.lower("name")).alias("exact"), F.col("bytes"), F.col("member"))
    return both.groupBy("path", "name").agg(F.max(best).alias("b")).select("path", "name", F.col("b.member").alias("member"), F.col("b.bytes").alias("bytes"))


def verify_pins(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``expected(name, id)``, stopping at a name whose actual id is another or missing."""
    joined = expected.join(actual.select("name", F.col("id").alias("_id")), "name", "left")
    wrong = F.when(~F.col("id").eqNullSafe(F.col("_id")), F.raise_error(F.concat(F.lit("pin differs: "), F.col("name"))).cast("boolean"))
    return joined.where(wrong.isNull()).drop("_id")


def archive_totals(members: DataFrame) -> DataFrame:
    """(path, members, bytes, packed, images, annotations, archives) of the inventory of ``zip_inventory``, all depths together."""
    return members.groupBy("path").agg(
        F.count("*").alias("members"), F.sum("bytes").alias("bytes"), F.sum("packed").alias("packed"), F.count_if("is_image").alias("images"), F.count_if("is_annotation").alias("annotations"), F.count_if("is_zip").alias("archives"))
