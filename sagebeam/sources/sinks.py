"""Writers: JSON lines, quoted CSV, a file per record or lane, checksum manifests, summaries."""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator
from decimal import Decimal
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebeam.operators.shared import scratch, stored


def write_json_lines(rows: DataFrame, path: str, *order: str) -> None:
    """One object per line, in order; range-sorted, so that files in name order hold it."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").json(path)


def pretty_json(rows: DataFrame, *order: str) -> str:
    """A small table as indented JSON with a final newline; for release files that fit the driver."""
    return json.dumps([json.loads(x) for x in rows.orderBy(*order).toJSON().collect()], indent=2, ensure_ascii=False) + "\n"


def js_number(value: float) -> str:
    """A finite number as JavaScript prints it: the shortest digits, an exponent from 1e21 up and below 1e-6; others are null."""
    if not math.isfinite(value):
        return "null"
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if value == 0:
        return "0"
    if 0 < point <= 21:
        out = text.ljust(point, "0") if len(text) <= point else f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        out = f"{text[0]}{'.' if text[1:] else ''}{text[1:]}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" * sign + out


def js_text(value, indent: str = "") -> str:
    """A parsed JSON value as JavaScript's stringify prints it with two blanks of indent."""
    inner = indent + "  "
    if isinstance(value, dict):
        parts = [f"{inner}{json.dumps(k, ensure_ascii=False)}: {js_text(v, inner)}" for k, v in value.items()]
        return "{\n" + ",\n".join(parts) + f"\n{indent}}}" if parts else "{}"
    if isinstance(value, list):
        return "[\n" + ",\n".join(inner + js_text(v, inner) for v in value) + f"\n{indent}]" if value else "[]"
    return js_number(value) if isinstance(value, float) else json.dumps(value, ensure_ascii=False)


def write_json_document(rows: DataFrame, path: str, *order: str, head: dict | None = None, field: str = "records") -> None:
    """One JSON document at ``path`` with the rows as its array, in order, byte for byte as JavaScript's stringify indents it, with a final newline.

    The array is the document, or with ``head`` its last member ``field`` after those of
    ``head``.  Rows are sorted by ranges and printed by the tasks; the first and the
    last row, found by their ordinals, carry the frame, so that the files of the tasks,
    one after the other, are the document.  They are copied into it as a stream,
    under a name of its own until it is whole; nothing is collected.  Rows that ``order`` does not
    tell apart come in any order.  Null fields are printed.
    """
    spark = rows.sparkSession
    base = "  " if head is None else "    "
    # An empty array is printed without a line of its own.
    open_, close = js_text([] if head is None else {**head, field: []}).rsplit("[]", 1)
    open_, close = f"{open_}[", f"]{close}"

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("id"), pa.array([base + js_text(json.loads(x, parse_float=float), base) for x in batch.column("json").to_pylist()], pa.string())], names=["id", "text"])

    whole = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    sorted_ = rows.orderBy(*order) if order else rows
    numbered = stored(sorted_.select(F.monotonically_increasing_id().alias("id"), whole.alias("json")), "json-rows")
    n, first, last = numbered.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if not n:
        _join_files(spark, spark.createDataFrame([(open_ + close,)], "value string"), path)
        return
    texts = numbered.mapInArrow(printed, "id long, text string")
    before = F.when(F.col("id") == first, F.lit(f"{open_}\n")).otherwise("")
    after = F.when(F.col("id") == last, F.lit("\n" + base[2:] + close)).otherwise(",")
    _join_files(spark, texts.orderBy("id").select(F.concat(before, "text", after).alias("value")), path)


def _join_files(spark: SparkSession, lines: DataFrame, path: str) -> None:
    """The lines of a table, in order, as one file, by way of its parts."""
    place = scratch(spark, "json-parts")
    lines.write.text(place)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(place), jvm.org.apache.hadoop.fs.Path(path)
    parts = sorted((f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    fs, out = target.getFileSystem(conf), None
    hidden = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex[:8]}")
    try:
        out = fs.create(hidden, True)
        for p in parts:
            source = p.getFileSystem(conf).open(p)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
    finally:
        if out is not None:
            out.close()
    fs.delete(target, False)
    fs.rename(hidden, target)


def cell(value: Column, is_array: bool) -> Column:
    """Text of a cell: arrays joined by a bar, null as empty."""
    return F.concat_ws(" | ", value) if is_array else F.coalesce(value.cast("string"), F.lit(""))


def write_csv(rows: DataFrame, path: str, quote_all: bool = True) -> None:
    """CSV with a header; every cell quoted and quotes doubled, or with minimal quoting."""
    flat = rows.select(*[cell(F.col(f.name), f.dataType.typeName() == "array").alias(f.name) for f in rows.schema])
    flat.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').option("emptyValue", "").csv(path)


def write_by_key(rows: DataFrame, path: str, key: str, spread: int = 1) -> None:
    """A folder per key (profiles, lanes), each key written by one task, or by up to ``spread`` where a key may have very many rows; rows keep their key as a column too."""
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(spread))
    rows.withColumn("_key", F.col(key)).repartition("_key", place).write.mode("overwrite").partitionBy("_key").json(path)


def lane_manifest(routed: DataFrame, lanes: DataFrame) -> DataFrame:
    """(lane, n, ids) of every lane, empty ones too."""
    grouped = routed.groupBy("lane").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
    return lanes.join(grouped, "lane", "left").select("lane", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.expr("cast(array() as array<string>)")).alias("ids"))


def checksums(spark: SparkSession, path: str, manifest: str = "SHA256SUMS") -> DataFrame:
    """``sha256  name`` lines of the files below ``path``, by their names below it, the manifest itself left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = re.escape(urlparse(path).path.rstrip("/") + "/")
    name = F.element_at(F.split("path", root, 2), -1)
    return files.where(name != manifest).select(F.concat(F.sha2("content", 256), F.lit("  "), name).alias("line"), name.alias("name")).orderBy("name").select("line")


def markdown(title: str, rows: DataFrame) -> str:
    """A small aggregated table as a Markdown summary."""
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect())]) + "\n"


def append_entry(log: DataFrame, entry: DataFrame) -> DataFrame:
    return log.unionByName(entry)


def newest_first(log: DataFrame, created: str = "createdAt") -> DataFrame:
    """Newest entries first, those of one time by id, so that a page of them is always the same."""
    return log.orderBy(F.desc(created), "id")


def remove_entry(log: DataFrame, ids: DataFrame) -> DataFrame:
    return log.join(ids, "id", "left_anti")
