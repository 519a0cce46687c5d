"""Files of any size as rows of byte ranges, and what needs their order: running digests and files put together.

A file is never a row: ranges are read apart, each by its own task, and a digest or a
file of all parts streams them in order through one task that holds one part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sagebeam.operators.shared import stored

PART = "path string, part int, offset long, length long, content binary"
#: Bytes of a range; a batch of rows holds one.
SIZE = 16 << 20


class _Range(InputPartition):
    def __init__(self, path: str, part: int, offset: int, length: int):
        self.path, self.part, self.offset, self.length = path, part, offset, length


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size = options["path"], int(options.get("size", SIZE))

    def partitions(self) -> list[_Range]:
        where, root = fs.FileSystem.from_uri(self.root)
        found = where.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else where.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted((f for f in files if f.type == fs.FileType.File), key=lambda f: f.path):
            out += [_Range(f.path, i, at, min(self.size, f.size - at)) for i, at in enumerate(range(0, max(1, f.size), self.size))]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.root)
        with where.open_input_file(partition.path) as f:
            f.seek(partition.offset)
            content = f.read(partition.length)
        if len(content) != partition.length:
            raise OSError(f"{partition.path} has changed while it was read")
        yield pa.record_batch([pa.array([partition.path]), pa.array([partition.part], pa.int32()), pa.array([partition.offset], pa.int64()), pa.array([partition.length], pa.int64()), pa.array([content], pa.binary())], ["path", "part", "offset", "length", "content"])


class FileRanges(DataSource):
    """``spark.read.format("sagebeam_ranges")``: the files of a URI (``path``; file:, hdfs:, s3: or what else pyarrow opens) in ranges of ``size`` bytes."""

    @classmethod
    def name(cls) -> str:
        return "sagebeam_ranges"

    def schema(self) -> str:
        return PART

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def file_ranges(spark: SparkSession, path: str, size: int = SIZE) -> DataFrame:
    """(path, part, offset, length, content) of the files at or below the URI ``path``; an empty file has one empty part."""
    spark.dataSource.register(FileRanges)
    return spark.read.format("sagebeam_ranges").option("size", str(size)).load(path)


def _in_order(parts: DataFrame) -> DataFrame:
    return parts.repartition("path").sortWithinPartitions("path", "part")


_FILE = "path string, parts long, bytes long, sha256 string"


def _checked(path: str, part: int, at: int, content: bytes, told: str | None) -> None:
    if part != at:
        raise ValueError(f"{path}: part {at} is missing or comes twice")
    if told is not None and hashlib.sha256(content).hexdigest() != told:
        raise ValueError(f"digests differ: {path}, part {part}")


def _with_digests(parts: DataFrame) -> DataFrame:
    return parts.select("path", F.col("part").cast("int").alias("part"), F.coalesce("content", F.lit(b"")).alias("content"), (F.col("sha256") if "sha256" in parts.columns else F.lit(None).cast("string")).alias("sha256"))


def digests(parts: DataFrame) -> DataFrame:
    """(path, parts, bytes, sha256) of files from ``parts`` (path, part from 0, content, perhaps sha256): a running digest over the parts in order.

    A part that is missing or comes twice, or whose digest is not the one told, stops the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, size, digest = None, 0, 0, None
        done = lambda: pa.record_batch([pa.array([at]), pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], ["path", "parts", "bytes", "sha256"])
        for batch in batches:
            for i in range(len(batch)):
                path, part, content, told = (batch.column(c)[i].as_py() for c in ("path", "part", "content", "sha256"))
                if path != at:
                    if at is not None:
                        yield done()
                    at, n, size, digest = path, 0, 0, hashlib.sha256()
                _checked(path, part, n, content, told)
                digest.update(content)
                n, size = n + 1, size + len(content)
        if at is not None:
            yield done()

    return _in_order(_with_digests(parts)).mapInArrow(run, _FILE)


def put_together(parts: DataFrame, folder: str, whole: DataFrame | None = None) -> DataFrame:
    """Write each file of ``parts`` (as of ``digests``; path is the name below the URI ``folder``) and return what ``digests`` returns.

    A task streams a file's parts into a hidden file and renames it once it is whole
    and, with ``whole`` (path, sha256), has the digest told; so a task that is run
    again, or fails, leaves no broken file.  Another digest stops the job, as does a
    file that ``whole`` does not tell.
    """
    told_parts = _with_digests(parts)
    joined = told_parts.join(whole.select("path", F.col("sha256").alias("whole")), "path", "left") if whole is not None else told_parts.withColumn("whole", F.lit(None).cast("string"))
    strict = whole is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        at, n, size, digest, want, out, hidden = None, 0, 0, None, None, None, ""

        def done() -> pa.RecordBatch:
            out.close()
            if strict and want != digest.hexdigest():
                where.delete_file(hidden)
                raise ValueError(f"digests differ: {at}")
            where.move(hidden, f"{root}/{at}")
            return pa.record_batch([pa.array([at]), pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], ["path", "parts", "bytes", "sha256"])

        for batch in batches:
            for i in range(len(batch)):
                path, part, content, told, expected = (batch.column(c)[i].as_py() for c in ("path", "part", "content", "sha256", "whole"))
                if path != at:
                    if at is not None:
                        yield done()
                    if path.startswith("/") or ".." in path.split("/"):
                        raise ValueError(f"unsafe name {path}")
                    at, n, size, digest, want = path, 0, 0, hashlib.sha256(), expected
                    parent, _, name = f"{root}/{path}".rpartition("/")
                    where.create_dir(parent, recursive=True)
                    hidden = f"{parent}/.{name}.{uuid.uuid4().hex[:8]}"
                    out = where.open_output_stream(hidden)
                _checked(path, part, n, content, told)
                digest.update(content)
                out.write(content)
                n, size = n + 1, size + len(content)
        if at is not None:
            yield done()

    return stored(_in_order(joined).mapInArrow(run, _FILE), "files-written")


def checksum_lines(parts: DataFrame) -> DataFrame:
    """``sha256  name`` lines by name, as a checksum manifest has them, of files of any size."""
    return digests(parts).select(F.concat("sha256", F.lit("  "), "path").alias("line"), "path").orderBy("path").select("line")
