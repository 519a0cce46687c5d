"""Scalar functions over the test tables: forms of hashes, names, URLs, links, responses, and lists."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from sagebeam.functions import text as T
from sagebeam.operators import merging, ordered
from sagebeam.plans.tables import Entry, scratch, spread, table
from sagebeam.sources import documents, ranges, sinks

T_SLIM = t.StructType([t.StructField("doc_id", t.LongType()), t.StructField("text", t.StringType()), t.StructField("lang", t.StringType())])


def hash_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts, and 64-bit words from hexadecimal digits and back; malformed ones are null."""
    digits = F.substring(F.sha2("text", 256), 1, 16)
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("dhash64:"), digits)).when(F.col("doc_id") % 3 == 1, F.upper(digits)).otherwise(F.concat(F.lit("x"), digits))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"), T.hex_bits(marked).alias("word"), T.bits_hex(T.hex_bits(marked)).alias("again"), T.hamming(T.hex_bits(marked), F.lit(255).cast("long")).cast("long").alias("distance"))


_HASHES = """
WITH d AS (SELECT doc_id, text, substr(sha256(text), 1, 16) AS h FROM documents)
SELECT doc_id, sha1(text) AS sha1, CASE WHEN doc_id % 3 < 2 THEN CAST(CASE WHEN ('0x' || h)::UBIGINT >= 9223372036854775808 THEN ('0x' || h)::UBIGINT::HUGEINT - 18446744073709551616 ELSE ('0x' || h)::UBIGINT::HUGEINT END AS BIGINT) END AS word,
  CASE WHEN doc_id % 3 < 2 THEN h END AS again, CASE WHEN doc_id % 3 < 2 THEN CAST(bit_count(xor(('0x' || h)::UBIGINT::BIT, 255::UBIGINT::BIT)) AS BIGINT) END AS distance FROM d
"""


def image_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their first bytes: pictures of five kinds, and other contents."""
    heads = ("FFD8FFE0", "89504E470D0A1A0A00", "474946383961", "474946383761", "49492A00", "4D4D002A", "524946460000000057454250", "524946460000000041564920", "25504446", "FFD8")
    content = F.concat(F.element_at(F.array(*[F.unhex(F.lit(h)) for h in heads]), (F.col("doc_id") % len(heads) + 1).cast("int")), F.unhex(F.lit("00112233445566778899")))
    return table(spark, sf_dir, "documents").groupBy(T.image_kind(content).alias("kind")).agg(F.count("*").alias("n"))


_KINDS = "SELECT CASE doc_id % 10 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'gif' WHEN 4 THEN 'tif' WHEN 5 THEN 'tif' WHEN 6 THEN 'webp' END AS kind, count(*) AS n FROM documents GROUP BY 1"


def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses: whether they are URLs, their file's ending by type or path, and where they have moved."""
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, "/x.JPG").otherwise("/y.tar"))
    url = F.when(F.col("page_id") % 10 == 9, F.concat(F.lit("no url "), F.col("page_id"))).otherwise(F.regexp_replace(url, r"[?#].*?(/[xy]\.\w+)?$", "$1"))
    kind = F.when(F.col("page_id") % 4 == 0, "image/PNG; charset=x").when(F.col("page_id") % 4 == 1, "text/html")
    return table(spark, sf_dir, "pages").select("page_id", T.valid_url(url).alias("valid"), T.url_extension(url, kind).alias("ending"), T.moved_url(F.concat(F.lit("https://old.org/"), F.col("page_id")), "old.org", "new.org").alias("moved"), T.moved_url(F.col("url"), "old.org", "new.org").alias("kept"))


_URLS = """
SELECT page_id, page_id % 10 <> 9 AS valid, CASE WHEN page_id % 4 = 0 THEN '.png' WHEN page_id % 10 = 9 THEN '' WHEN page_id % 3 = 1 THEN '.jpg' WHEN page_id % 3 = 2 THEN '.tar' ELSE lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+/.*?(\\.[A-Za-z0-9]+)$', 1)) END AS ending,
  'https://new.org/' || page_id AS moved, url AS kept FROM pages
"""


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made safe, and whether paths, model names and hosts are allowed."""
    path = F.concat(F.when(F.col("doc_id") % 5 == 0, "/").when(F.col("doc_id") % 5 == 1, "a/../").when(F.col("doc_id") % 5 == 2, "C:").when(F.col("doc_id") % 5 == 3, "a/..b/").otherwise("a/"), F.lit("b"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.safe_id(F.col("text")).alias("safe"), T.safe_path(path).alias("path_ok"), T.model_name(F.concat(F.col("source"), F.when(F.col("lang") == "en", "/").otherwise("-1.x"))).alias("model_ok"),
        T.same_host(F.concat(F.upper("source"), F.lit(":80")), F.when(F.col("lang") == "de", F.col("source")).otherwise("other")).alias("same_host"))


_SAFE = """
SELECT doc_id, regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS safe, doc_id % 5 >= 3 AS path_ok, lang <> 'en' AS model_ok, lang = 'de' AS same_host FROM documents
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers of a vision model: unfenced, with defaults, and only what is allowed."""
    level = F.when(F.col("event_type") == "click", "HIGH").when(F.col("event_type") == "view", "sure").otherwise("moderate")
    body = F.concat(F.lit('{"confidence": "'), level, F.lit('", "matched": ["'), F.col("event_type"), F.lit('", "leaf", "'), F.col("event_type"), F.lit('"]'), F.when(F.col("event_id") % 2 == 0, ', "summary": "seen"').otherwise(""), F.lit("}"))
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, body).otherwise("no json")
    seen = T.observation(raw, F.array(F.lit("leaf"), F.lit("click"), F.lit("view")))
    rows = table(spark, sf_dir, "events").select(seen.alias("o"))
    return rows.groupBy(F.col("o.confidence").alias("confidence"), F.col("o.summary").alias("summary"), F.array_join("o.matched", "|").alias("matched")).agg(F.count("*").alias("n"))


_OBSERVED = """
SELECT CASE WHEN event_id % 3 = 2 OR event_type = 'view' THEN 'low' WHEN event_type = 'click' THEN 'high' ELSE 'moderate' END AS confidence, CASE WHEN event_id % 3 < 2 AND event_id % 2 = 0 THEN 'seen' ELSE '' END AS summary,
  CASE WHEN event_id % 3 = 2 THEN '' WHEN event_type IN ('click', 'view') THEN event_type || '|leaf' ELSE 'leaf' END AS matched, count(*) AS n FROM events GROUP BY ALL
"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct links of pages, in order."""
    found = documents.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.get(found, F.lit(0)).alias("first"))


_LINKS = """
WITH l AS (SELECT page_id, regexp_extract_all(html, 'https?://[^\\s"''<>]+') AS u FROM pages)
SELECT page_id, CAST(len(list_distinct(u)) AS BIGINT) AS n, u[1] AS first FROM l
"""


def figure_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a figure for every turn of a conversation: numbers of labels and files of graphics."""
    figure = F.concat(F.lit("<fig id='f'>\n<label>Figure "), F.col("turn") + 1, F.lit('</label>\n<graphic xlink:href="'), F.col("role"), F.lit('.jpg"/></fig>'))
    articles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", figure.alias("f"))))["f"], "<p>x</p>").alias("xml"))
    return articles.select("conv_id", F.explode(documents.figure_links(F.col("xml"))).alias("f")).select("conv_id", F.col("f.label").alias("label"), F.col("f.href").alias("href"))


_FIGURES = "SELECT conv_id, CAST(turn + 1 AS VARCHAR) AS label, role || '.jpg' AS href FROM conversations"


def pinned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations pinned to their regions: every pin holds, else the query stops."""
    nations = table(spark, sf_dir, "nation")
    return documents.verify_pins(nations.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("id")), nations.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("id")))


_PINS = "SELECT n_name AS name, n_regionkey AS id FROM nation"


def archive_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as members of the archives of their brands: totals of each."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_size").cast("long").alias("bytes"), (F.col("p_size") / 2).cast("long").alias("packed"), (F.col("p_type") == "ECONOMY").alias("is_image"), (F.col("p_size") > 40).alias("is_annotation"), (F.col("p_size") == 7).alias("is_zip"))
    return documents.archive_totals(rows)


_ARCHIVES = """
SELECT p_brand AS path, count(*) AS members, CAST(sum(p_size) AS BIGINT) AS bytes, CAST(sum(p_size // 2) AS BIGINT) AS packed, count(*) FILTER (p_type = 'ECONOMY') AS images, count(*) FILTER (p_size > 40) AS annotations, count(*) FILTER (p_size = 7) AS archives FROM part GROUP BY p_brand
"""


def file_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files cut into parts and joined again: the digest is the file's own."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    parts = documents.split_parts(files, 1000)
    whole = documents.joined_parts(parts).select("path", F.sha2("content", 256).alias("sha256"))
    return whole.join(parts.groupBy("path").agg(F.count("*").alias("parts")), "path")


_FILE_PARTS = "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256, CAST(greatest(1, ceil(octet_length(encode(text)) / 1000.0)) AS BIGINT) AS parts FROM documents"


def pending_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of turns that a vocabulary has, as often as they are there, and those of them that are not chosen yet."""
    words, known = F.split(F.lower("text"), " "), F.array(*map(F.lit, ("the", "and", "of", "en")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.only_in(words, known).alias("matched"))
    return rows.select("conv_id", "turn", F.array_join("matched", "|").alias("matched"), F.array_join(F.array_distinct(T.not_in(F.col("matched"), F.array(F.lit("the")))), "|").alias("pending"))


_PENDING = """
WITH m AS (SELECT conv_id, turn, list_filter(string_split(lower(text), ' '), lambda w: w IN ('the', 'and', 'of', 'en')) AS m FROM conversations),
p AS (SELECT *, list_filter(m, lambda w: w <> 'the') AS r FROM m)
SELECT conv_id, turn, array_to_string(m, '|') AS matched, array_to_string(list_filter(r, lambda w, i: list_position(r, w) = i), '|') AS pending FROM p
"""


def sign_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct words of the benchmark, in order."""
    return ordered.sign_vocabulary(table(spark, sf_dir, "benchmark").select(F.split(F.lower("text"), "[^a-z]+").alias("signs")), "signs")


_VOCABULARY = "SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS sign FROM benchmark"


def newest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of events without those of an error's user and second, newest first, cut to what one page shows."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("createdAt"), "event_type")
    log = sinks.append_entry(events.where("event_type <> 'view'"), events.where("event_type = 'view'"))
    kept = sinks.remove_entry(log, events.where("event_type = 'error'").select("id"))
    return sinks.newest_first(kept).select("id", "user_id", "event_type").limit(50)


_LOG = "SELECT event_id AS id, user_id, event_type FROM events WHERE event_type <> 'error' ORDER BY ts DESC, event_id LIMIT 50"


def lane_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by region as lanes with their records, empty lanes too."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("lane"), F.col("n_name").alias("id"))
    out = sinks.lane_manifest(rows, spark.createDataFrame([(str(i),) for i in range(7)], "lane string"))
    return out.select("lane", "n", F.array_join("ids", "|").alias("ids"))


_LANE_ROWS = "SELECT CAST(i AS VARCHAR) AS lane, count(n_name) AS n, coalesce(string_agg(n_name, '|' ORDER BY n_name), '') AS ids FROM range(0, 7) AS t(i) LEFT JOIN nation ON n_regionkey = i GROUP BY i"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a CSV: arrays joined, nulls empty."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"), F.when(F.col("lang") == "en", F.col("n_chars")).alias("n"))
    return rows.select("doc_id", sinks.cell(F.col("words"), True).alias("words"), sinks.cell(F.col("n"), False).alias("n"))


_CELLS = "SELECT doc_id, array_to_string(string_split(text, ' '), ' | ') AS words, CASE WHEN lang = 'en' THEN CAST(n_chars AS VARCHAR) ELSE '' END AS n FROM documents"


def id_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New random ids have their form and are all different; the ids themselves differ in every run."""
    made = table(spark, sf_dir, "nation").select(T.random_id("case").alias("id"))
    return made.agg(F.count_if(F.regexp_like("id", F.lit("^case-[0-9]{13}-[0-9a-f]{6}$"))).alias("well_formed"), F.countDistinct("id").alias("distinct_ids"))


_ID_FORMS = "SELECT count(*) AS well_formed, count(*) AS distinct_ids FROM nation"

_SLIM = "doc_id long, text string, lang string"


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read again."""
    path = scratch(spark, "json")
    sinks.write_json_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    good, _ = documents.json_lines(spark, path, T_SLIM)
    return good.select("doc_id", F.sha2("text", 256).alias("digest"), "lang")


_JSON = "SELECT doc_id, sha256(text) AS digest, lang FROM documents"


def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order as one JSON document with an envelope, printed by ranges and read again."""
    path = f"{scratch(spark, 'document')}.json"
    sinks.write_json_document(spread(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang"), path, "doc_id", head={"version": 1})
    return documents.indented_records(spark, path, T_SLIM).select("doc_id", F.sha2("text", 256).alias("digest"), "lang")


def json_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as batches of JSON arrays, a file each; of a conversation's records that of the last batch stands."""
    path = scratch(spark, "batches")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text", F.col("role").alias("lang"), F.least("turn", F.lit(3)).alias("batch"), "turn")
    last = turns.groupBy("doc_id", "batch").agg(F.max_by(F.struct("doc_id", "text", "lang"), "turn").alias("r"))
    files = last.groupBy("batch").agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("value"))
    files.repartition("batch").write.partitionBy("batch").text(path)
    return documents.json_batches(spark, f"{path}/batch=*/*", T_SLIM, "doc_id").select("doc_id", F.sha2("text", 256).alias("digest"), "lang")


_BATCHES = "SELECT conv_id AS doc_id, sha256(arg_max(text, turn)) AS digest, arg_max(role, turn) AS lang FROM conversations GROUP BY conv_id"


def csv_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV that quotes only where it must, and read again."""
    path = scratch(spark, "csv-minimal")
    sinks.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, quote_all=False)
    back = spark.read.schema(_SLIM).option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").csv(path)
    return back.select("doc_id", F.sha2(F.regexp_replace("text", "\r\n?", "\n"), 256).alias("digest"), "lang")


def _source_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a file whose parts are its texts."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit(".txt")).alias("path"), place.cast("int").alias("part"), F.encode("text", "UTF-8").alias("content"), F.sha2("text", 256).alias("sha256"))


def part_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running digests of files over their parts in order."""
    return ranges.digests(_source_parts(spark, sf_dir))


_PARTS_DIGESTS = "SELECT source || '.txt' AS path, count(*) AS parts, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes, sha256(string_agg(coalesce(text, ''), '' ORDER BY doc_id)) AS sha256 FROM documents WHERE source IS NOT NULL GROUP BY source"


def ranges_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files put together from their parts, read again by ranges of bytes: sizes and digests."""
    folder = scratch(spark, "files")
    ranges.put_together(_source_parts(spark, sf_dir), folder)
    found = ranges.digests(ranges.file_ranges(spark, folder, 300_000))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("path"), "parts", "bytes", "sha256")


_RANGES = f"SELECT path, CAST(greatest(1, ceil(bytes / 300000.0)) AS BIGINT) AS parts, bytes, sha256 FROM ({_PARTS_DIGESTS})"


def envelope_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the hundred in JSON documents with an envelope, a file each, read again."""
    path = scratch(spark, "envelope")
    whole = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 100).alias("batch")).agg(F.collect_list(F.struct("doc_id", "text", "lang")).alias("records"))
    whole.select("batch", F.to_json(F.struct("records")).alias("value")).write.partitionBy("batch").text(path)
    return documents.json_records(spark, path, T_SLIM).select("doc_id", F.sha2("text", 256).alias("digest"), "lang")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as quoted CSV, quotes doubled and lines kept in cells, and read again."""
    path = scratch(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    back = spark.read.schema(_SLIM).option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").csv(path)
    return back.select("doc_id", F.sha2(F.regexp_replace("text", "\r\n?", "\n"), 256).alias("digest"), "lang")


_CSV = "SELECT doc_id, sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS digest, lang FROM documents"


def keyed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to a folder per source; files found in the tree, with their digests, and the rows that they hold."""
    path = scratch(spark, "keyed")
    sinks.write_by_key(table(spark, sf_dir, "documents"), path, "source")
    files = documents.file_tree(spark, path, ("json",), content=True).select(F.regexp_extract("path", "_key=([^/]+)/", 1).alias("source"), F.size(F.split(F.decode("content", "UTF-8"), "\n")).alias("lines"))
    listed = sinks.checksums(spark, path).agg(F.count_if(F.regexp_like("line", F.lit("^[0-9a-f]{64}  _key="))).alias("sums"), F.count("*").alias("names"))
    return files.groupBy("source").agg((F.sum("lines") - F.count("*")).cast("long").alias("n")).crossJoin(listed.select((F.col("sums") >= F.col("names") - 1).alias("listed")))  # a row


_KEYED = "SELECT source, count(*) AS n, true AS listed FROM documents GROUP BY source"


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations packed as zip archives, those of later turns inside others, and their members read again."""

    def packed(batches):
        for batch in batches:
            out = []
            for roles, texts in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                data = b""
                for i, (role, text) in reversed(list(enumerate(zip(roles, texts, strict=True)))):
                    stream = io.BytesIO()
                    with zipfile.ZipFile(stream, "w") as z:
                        z.writestr(f"{role}-{i}.txt", text)
                        if data:
                            z.writestr("more.zip", data)
                    data = stream.getvalue()
                out.append(data)
            yield pa.record_batch([batch.column("conv_id").cast(pa.string()), pa.array(out, pa.binary())], names=["path", "content"])

    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    archives = turns.select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts")).mapInArrow(packed, "path string, content binary")
    return documents.zip_inventory(archives).where("not is_zip").select(F.regexp_extract("path", "^[0-9]+", 0).alias("conversation"), "member", "bytes", F.col("depth").cast("long").alias("depth"), "is_annotation")


_ARCHIVED = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS conversation, role || '-' || i || '.txt' AS member, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, CAST(i AS BIGINT) AS depth, true AS is_annotation FROM t
"""


def unique_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two halves of the customers as one catalogue, each order once."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return merging.unique_union([orders.where("o_custkey % 2 = 0"), orders.where("o_custkey % 2 = 1")], "o_orderkey")


_UNIQUE_UNION = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"

QUERIES: dict[str, Entry] = {
    "hash_forms": (hash_forms, _HASHES),
    "image_kinds": (image_kinds, _KINDS),
    "url_forms": (url_forms, _URLS),
    "safe_names": (safe_names, _SAFE),
    "observations": (observations, _OBSERVED),
    "page_links": (page_links, _LINKS),
    "figure_files": (figure_files, _FIGURES),
    "pinned_ids": (pinned_ids, _PINS),
    "archive_totals": (archive_totals, _ARCHIVES),
    "file_parts": (file_parts, _FILE_PARTS),
    "pending_signs": (pending_signs, _PENDING),
    "sign_vocabulary": (sign_vocabulary, _VOCABULARY),
    "newest_log": (newest_log, _LOG),
    "lane_manifests": (lane_manifests, _LANE_ROWS),
    "csv_cells": (cells, _CELLS),
    "id_forms": (id_forms, _ID_FORMS),
    "json_round_trip": (json_round_trip, _JSON),
    "json_document": (json_document, _JSON),
    "json_batches": (json_batches, _BATCHES),
    "csv_minimal": (csv_minimal, _CSV),
    "part_digests": (part_digests, _PARTS_DIGESTS),
    "ranges_round_trip": (ranges_round_trip, _RANGES),
    "envelope_round_trip": (envelope_round_trip, _JSON),
    "csv_round_trip": (csv_round_trip, _CSV),
    "keyed_files": (keyed_files, _KEYED),
    "archive_members": (archive_members, _ARCHIVED),
    "unique_union": (unique_union, _UNIQUE_UNION),
}
