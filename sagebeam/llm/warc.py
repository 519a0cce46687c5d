"""A deterministic sharded WARC writer, and its reader.

Records are range-sorted by page: ranges are cut at keys that a hash picks, so
they follow from the rows alone.  Each task writes one range and starts a new file
when the compressed size of the last reaches a limit, and every record is a
gzip member of its own with regenerated headers and digests.  Tasks write under
temporary names that hold their attempt; only the attempts whose manifest rows
Spark has committed are renamed, by tasks of their own, and a manifest written last makes the folder
complete.  Lost or repeated tasks leave temporary files at most.

Which pages repeat an earlier payload is decided on digests alone.  The decisions
travel as small rows that sort just before their page, so the pages themselves
are shuffled once.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebeam.llm.frames import bounded_batches, discard, scratch, stored

#: Compressed bytes at which a file ends.
ROLL_BYTES = 64 << 20
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of a range, ranges of that size at most, and bytes of a range beyond that number; bytes that a record has besides its payload, about.
_RANGE_BYTES, _RANGES, _LARGEST, _OVERHEAD = 16 << 20, 4096, 1 << 30, 700
#: Keys of the sample that ranges are cut by, for each of them.
_PER_RANGE = 64
_KEY = "S41"
_FILE_TASKS = 20_000
_MANIFEST = "temporary string, name string, records long, bytes long, sha256 string"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}:{digest}'.encode()).hexdigest()[:32])}>"


def _header_value(text: str) -> str:
    """Text without line breaks or other control characters, as headers need it; these are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or ord(c) == 0x7F else c for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the page ``refers_to`` without one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _header_value(url)))
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("Refers-To-Page-Id", str(refers_to))]
    if page_id is not None:
        fields.append(("Page-Id", str(page_id)))
    fields += [("Payload-Length", str(size)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """``data`` as a gzip member without name or time, the same in every run."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), f"{context.stageId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        fs, base = _filesystem(folder)
        done: list[tuple[str, str, int, int, str]] = []
        out, seal, records, size = None, None, 0, 0
        refers = (None, None, None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    refers = (row["page_id"], row["digest"], row["refers_to"])
                    continue
                to = refers[2] if refers[:2] == (row["page_id"], row["digest"]) else None
                if out is None:
                    name = f"part-{part:05d}-{len(done):05d}.warc.gz"
                    fs.create_dir(f"{base}/_temporary", recursive=True)
                    path = f"_temporary/{name}.{attempt}"
                    out, seal, records, size = fs.open_output_stream(f"{base}/{path}", compression=None), hashlib.sha256(), 0, 0
                data = _member(record(row["page_id"], row["url"], row["payload"], row["digest"], row["size"], to, date))
                out.write(data)
                seal.update(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    done.append((path, name, records, size, seal.hexdigest()))
                    out = None
        if out is not None:
            out.close()
            done.append((path, name, records, size, seal.hexdigest()))
        columns = list(zip(*done, strict=True)) if done else [[]] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["temporary", "name", "records", "bytes", "sha256"])

    return run


def _cuts(rows: DataFrame, most: int) -> np.ndarray:
    """Keys at which ``rows`` (key, text) are cut into at most ``most`` ranges: those of a sample that the keys' own hashes choose, so the same in every run.

    About ``_PER_RANGE`` keys of each range reach the driver.
    """
    total = rows.count()
    share = min(1.0, most * _PER_RANGE / max(1, total))
    picked = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("key").toArrow()
    keys = np.sort(np.array(picked.column("key").to_pylist(), dtype=_KEY))
    return np.unique(keys[[len(keys) * i // most for i in range(1, most)]]) if len(keys) else keys


def _ranges(cuts: np.ndarray):
    """The number of a key's range, as a function of a column of keys."""

    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy().astype(_KEY), side="right").astype(np.int32))

    return number


def ranges_of(total_bytes: int) -> int:
    """Ranges by the payloads' bytes: ``_RANGE_BYTES`` each, or larger ones where there would be more than ``_RANGES`` of these."""
    return max(1, min(-(-total_bytes // _RANGE_BYTES), _RANGES), -(-total_bytes // _LARGEST))


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; returns the manifest.

    The payload is the html in UTF-8 (null: empty).  Of equal payloads of at least
    100 bytes the record with the smallest page_id is a response and the others
    revisit it; shorter ones are all responses.  Rows that share that smallest
    page_id are all responses.  A null page_id is never the smallest; where all are
    null, all are responses.  A null url leaves its header out; control characters
    in a url are percent-encoded.  Repeated rows each make a record.  An empty table
    makes no archive and an empty manifest.  Extra columns are not read.  The same
    rows make the same files in every run, however they are partitioned.
    """
    spark = bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    # Keys sort as (page_id, digest) do, nulls first; the url parts rows that agree in both.
    number = F.when(F.col("page_id").isNull(), F.lit("-" * 16)).otherwise(F.lpad(F.hex(F.col("page_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    near = F.concat(number, F.substring("digest", 1, 16))
    rows = rows.withColumn("key", F.concat(near, F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 8)))
    slim, slim_path = stored(rows.select("page_id", "digest", "size", "key"), "warc-digests")
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] + _OVERHEAD * slim.count()
    cuts = _cuts(slim, ranges_of(total))
    parts, ranged = len(cuts) + 1, _ranges(cuts)
    long = slim.where(F.col("size") >= LEAST_REVISIT)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    revisits = long.select("page_id", "digest", F.substring("key", 1, 32).alias("near")).distinct().join(firsts, "digest").where("page_id is null or page_id > first")
    kind = pages.schema["page_id"].dataType
    # A decision goes to every range that its page may be in: one, unless many rows share page and payload.
    placed = revisits.withColumn("lo", ranged(F.col("near"))).withColumn("hi", ranged(F.concat("near", F.lit("~")))).withColumn("part", F.explode(F.sequence("lo", "hi")))
    decisions = placed.select("part", "page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("long").alias("size"), F.col("first").cast(kind).alias("refers_to"))
    both = rows.select(ranged(F.col("key")).alias("part"), "page_id", "digest", F.lit(1).alias("kind"), "url", "payload", "size", F.lit(None).cast(kind).alias("refers_to")).unionByName(decisions)
    dealt = both.repartitionById(parts, F.col("part")).sortWithinPartitions("page_id", "digest", "kind", F.md5(F.coalesce("url", F.lit("")).cast("binary")), "url")
    written, written_path = stored(dealt.drop("part").mapInArrow(_writer(folder, roll_bytes, date), _MANIFEST), "warc-manifest")
    named, _ = stored(_renamed(written, folder), "warc-names")
    _commit(spark, folder, named)
    discard(spark, slim_path, written_path)
    return named.select("name", "records", "bytes", "sha256")


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The store and path of a folder, also by the names that Spark has for stores."""
    for spark_name, name in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if folder.startswith(spark_name):
            folder = name + folder.removeprefix(spark_name)
    return pafs.FileSystem.from_uri(folder)


def _by_file(manifest: DataFrame) -> DataFrame:
    """``manifest`` with a file a task, up to ``_FILE_TASKS`` tasks."""
    files = manifest.count()
    tasks = max(1, min(files, _FILE_TASKS))
    return manifest.repartitionById(tasks, F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33), F.lit(tasks)).cast("int"))


def _renamed(written: DataFrame, folder: str) -> DataFrame:
    """The manifest rows of committed attempts, whose files have got their names; one that has its name already was moved by an earlier try."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for batch in batches:
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist(), strict=True):
                if fs.get_file_info(f"{base}/{temporary}").type != pafs.FileType.NotFound:
                    fs.move(f"{base}/{temporary}", f"{base}/{name}")
                elif fs.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
                    raise OSError(f"{temporary} and {name} are both missing")
            yield batch

    return _by_file(written).mapInArrow(run, _MANIFEST)


def _commit(spark: SparkSession, folder: str, named: DataFrame) -> None:
    """Drop what lost attempts have left, and write the manifest, which makes the folder complete, last."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    fs.delete(path(f"{folder}/_temporary"), True)
    stream = fs.create(path(f"{folder}/_manifest.tmp"), True)
    for r in named.orderBy("name").toLocalIterator():
        stream.write(bytearray((json.dumps({k: r[k] for k in ("name", "records", "bytes", "sha256")}, sort_keys=True) + "\n").encode()))
    stream.close()
    fs.delete(path(f"{folder}/manifest.jsonl"), False)
    fs.rename(path(f"{folder}/_manifest.tmp"), path(f"{folder}/manifest.jsonl"))


class _Inflated:
    """Reads the bytes of concatenated gzip members from a stream."""

    def __init__(self, source):
        self.source, self.z, self.left, self.ready = source, zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        data = self.left or self.source.read(1 << 18)
        if not data:
            return False
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        self.ready += self.z.decompress(data)
        self.left = self.z.unused_data
        return True

    def line(self) -> bytes:
        while (at := self.ready.find(b"\r\n")) < 0:
            if not self._more():
                return b""
        out = bytes(self.ready[:at])
        del self.ready[: at + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of a stream of gzip members."""
    data = _Inflated(source)
    while (version := data.line()) != b"":
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {version[:40]!r}")
        head: dict[str, str] = {}
        while (text := data.line().decode()) != "":
            name, _, value = text.partition(":")
            head[name.lower()] = value.strip()
        yield head, data.take(int(head["content-length"]))
        if data.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


_READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("sound", pa.bool_())])


def _reader(folder: str, payloads: bool):
    def row(head: dict[str, str], block: bytes) -> tuple:
        digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(head["payload-length"])
        sound = head["warc-block-digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}"
        payload = None
        if head["warc-type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            digest, told, size, said = hashlib.sha256(payload).hexdigest(), digest, len(payload), size
            sound = sound and digest == told and size == said
        number = lambda k: int(head[k]) if k in head else None
        return number("page-id"), head["warc-type"], head.get("warc-target-uri"), size, digest, number("refers-to-page-id"), payload if payloads else None, sound

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for names in batches:
            for name in names.column("name").to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
                    rows, held = [], 0
                    for head, block in records(source):
                        rows.append(row(head, block))
                        held += len(block)
                        if len(rows) >= 1024 or held >= 1 << 24:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return run


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives that ``manifest`` (name) lists: page_id, record_type, url,
    payload_bytes and payload_digest (both of the full payload), refers_to, payload, sound (its digests agree)."""
    schema = "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, sound boolean"
    return _by_file(manifest.select("name")).mapInArrow(_reader(folder, payloads), schema)


def round_trip(pages: DataFrame, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read these back: a row per page, as ``read_archives`` without payloads."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    return read_archives(write_archives(pages, folder, roll_bytes), folder, payloads=False).drop("payload")
