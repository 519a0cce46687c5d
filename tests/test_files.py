"""Ordered JSON documents, byte ranges and running digests, and packing, against plain Python."""

from __future__ import annotations

import hashlib
import heapq
import json
import random

import pytest
from pyspark.sql import functions as F

from sagebeam.operators import annotations, packing
from sagebeam.sources import documents, ranges, sinks


@pytest.mark.parametrize("head", [None, {}, {"version": 1, "at": "x"}])
def test_json_document_is_what_stringify_prints(spark, tmp_path, head):
    rows = [(i, f'é"\n{i}', [1.0 * i, 0.5] if i % 3 else [], None if i % 2 else {"k": 1e-7 * i}) for i in range(40)]
    frame = spark.createDataFrame(random.Random(1).sample(rows, 40), "id int, s string, l array<double>, m map<string,double>").repartition(5)
    for n in (40, 1, 0):
        sinks.write_json_document(frame.where(F.col("id") < n), str(tmp_path / "out.json"), "id", head=head)
        values = [dict(zip(("id", "s", "l", "m"), r, strict=True)) for r in rows[:n]]
        want = values if head is None else {**head, "records": values}
        text = (tmp_path / "out.json").read_text()
        assert json.loads(text) == want and text == sinks.js_text(want) + "\n"
        # Only numbers are printed otherwise than Python would.
        assert text.count("\n") == json.dumps(want, indent=2).count("\n") + 1
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["out.json"]


@pytest.mark.parametrize("head", [None, {}, {"version": 1, "marks": [{"id": -1, "s": "x"}, {"id": -2, "s": "y"}]}])
def test_a_json_document_is_read_in_ranges(spark, tmp_path, head):
    """A document of many times a split's size is many tasks, and has the same records."""
    rows = [(i, f'é"\n    }},\n    {{\\{i}' * (i % 7), [{"k": i, "v": [i]}, {"k": None, "v": []}]) for i in range(200)]
    schema = "id int, s string, l array<struct<k:int,v:array<int>>>"
    frame, path = spark.createDataFrame(rows, schema), str(tmp_path / "out.json")
    envelope = None if head is None else "records"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for n in (200, 1, 0):
            sinks.write_json_document(frame.where(F.col("id") < n), path, "id", head=head)
            got = documents.indented_records(spark, path, frame.schema, envelope)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, documents.json_records(spark, path, frame.schema, envelope).collect())) == sorted(map(repr, frame.where(F.col("id") < n).collect()))
            if n == 200:
                assert got.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_numbers_as_javascript_prints_them():
    values = {1.0: "1", -0.5: "-0.5", 1e21: "1e+21", 123456789012345680000.0: "123456789012345680000", 1e-6: "0.000001", 1.5e-7: "1.5e-7", 5e-324: "5e-324", 0.1: "0.1", -0.0: "0", 100.0: "100", 123.456: "123.456", float("inf"): "null"}
    assert {v: sinks.js_number(v) for v in values} == values


def test_ranges_digests_and_files_put_together(spark, tmp_path):
    rng = random.Random(3)
    files = {"a/one.bin": rng.randbytes(1000), "a/two.bin": rng.randbytes(128), "empty": b"", "b": rng.randbytes(129)}
    for name, data in files.items():
        place = tmp_path / "in" / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(data)
    found = ranges.file_ranges(spark, f"file://{tmp_path}/in", 64)
    assert max(r["length"] for r in found.select("length").collect()) == 64
    got = {r["path"].removeprefix(f"{tmp_path}/in/"): (r["parts"], r["bytes"], r["sha256"]) for r in ranges.digests(found.repartition(7)).collect()}
    want = {k: (max(1, -(-len(v) // 64)), len(v), hashlib.sha256(v).hexdigest()) for k, v in files.items()}
    assert got == want
    parts = found.withColumn("path", F.regexp_replace("path", f"^{tmp_path}/in/", "")).withColumn("sha256", F.sha2("content", 256)).cache()
    whole = spark.createDataFrame([(k, v[2]) for k, v in want.items()], "path string, sha256 string")
    assert ranges.put_together(parts, f"file://{tmp_path}/out", whole).count() == 4
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == files
    lines = [r["line"] for r in ranges.checksum_lines(parts).collect()]
    assert lines == [f"{want[k][2]}  {k}" for k in sorted(files)]
    for broken, message in ((parts.where("not (path = 'b' and part = 1)").where("not (path = 'a/one.bin' and part = 3)"), "missing or comes twice"), (parts.unionByName(parts), "missing or comes twice"), (parts.withColumn("sha256", F.lit("0")), "digests differ")):
        with pytest.raises(Exception, match=message):
            ranges.digests(broken).collect()
    with pytest.raises(Exception, match="digests differ"):
        ranges.put_together(parts, f"file://{tmp_path}/bad", whole.withColumn("sha256", F.lit("0")))
    assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file() and not p.name.startswith(".")]


def test_packing_by_runs_is_packing_item_by_item(spark):
    rng = random.Random(5)
    items = [(rng.choice(["g", "h", None]), rng.choice("aAbBcd") + str(i), rng.choice([0, 1, 1, 3, 3, 3, 7, None])) for i in range(200)]
    got = {(r["g"], r["name"]): r["bin"] for r in packing.pack(spark.createDataFrame(items, "g string, name string, size long").repartition(3), ["g"], "name", "size", 3).collect()}
    want = {}
    for group in ("g", "h", None):
        loads = [(0, i) for i in range(3)]
        for _, name, size in sorted((r for r in items if r[0] == group), key=lambda r: (-(r[2] or 0), r[1].lower(), r[1])):
            load, i = heapq.heappop(loads)
            want[group, name] = i
            heapq.heappush(loads, (load + (size or 0), i))
    assert got == want
    with pytest.raises(Exception, match="below 0"):
        packing.pack(spark.createDataFrame([("x", -1)], "name string, size long"), [], "name", "size", 2).collect()


def test_runs_of_many_equal_sizes_are_few_stretches():
    loads = [5, 0, 3, 3]
    stretches = packing.fill(loads, 2, 1_000_001)
    assert len(stretches) <= 4 and sum(loads) == 11 + 2_000_002 and max(loads) - min(loads) <= 2


def test_annotation_sample_by_names_and_early_stop(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    tokens = ["1", "0.5", "x", "1_0", "1__0", "-1", "nan", "inf", "1e-3", ".5", "5.", "1d", "0x1", "+.5e1"]
    files = {f"{i:03d}.txt": "\r\n".join(rng.choice(["", " \t", " ".join(rng.choice(tokens[: rng.choice([2, 14])]) for _ in range(rng.choice([1, 3, 5, 5])))]) for _ in range(rng.randrange(6))) for i in range(60)}
    for name, text in files.items():
        (tmp_path / name).write_text(text, newline="")
    (tmp_path / "000.jpg").write_text("not text")

    def number(x):
        try:
            return float(x)
        except ValueError:
            return None

    lines = [s.strip() for name in sorted(files) for s in files[name].splitlines() if s.strip()]
    monkeypatch.setattr(annotations, "FILES", 2)
    for most in (1, 40, 10_000):
        want = lines[:most]
        frame = annotations.read_sample(spark, str(tmp_path), most=most)
        assert [r["line"] for r in frame.orderBy("path", "at").collect()] == want
        got = {(r["what"], r["at"]): r["text"] if r["what"] == "example" else r["n"] for r in annotations.profile(frame).collect()}
        values = [[number(t) for t in x.split()] for x in want]
        numeric = [v for v in values if None not in v]
        assert got["sampled", 0] == len(want) and got["numeric", 0] == len(numeric)
        assert got["yolo5", 0] == sum(len(v) == 5 and v[0] >= 0 and all(0 <= x <= 1 for x in v[1:]) for v in numeric)
        assert {k: n for (w, k), n in got.items() if w == "tokens"} == {k: sum(len(v) == k for v in values) for k in {len(v) for v in values}}
        assert [got["example", i] for i in range(min(20, len(want)))] == want[:20]
    assert annotations.read_sample(spark, str(tmp_path), ".none").count() == 0
