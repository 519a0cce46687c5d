"""Operators against brute force, fixed values and stops, on small inputs."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as t

from sagebeam.functions import paths
from sagebeam.functions import text as T
from sagebeam.operators import coverage, dedup, media, merging, ordered, packing, ranking, routing, scoring, validation
from sagebeam.sources import documents, sinks


def test_no_record_of_the_own_host_is_sent_away(spark):
    rows = spark.createDataFrame([("hemp mite", "", ""), ("tomato mite", "cross-crop", "tomato")], "blob string, host_context string, host_species string")
    lane = routing.lane(F.col("blob"), F.col("host_context"), F.col("host_species"))
    assert routing.assert_kept_home(rows.withColumn("lane", lane), "blob").count() == 2
    wrong = rows.withColumn("host_context", F.lit("cross-crop")).withColumn("lane", lane)
    with pytest.raises(Exception, match="routed to transfer"):
        routing.assert_kept_home(wrong, "blob").collect()


def test_block_scores_are_those_of_the_joins(spark, monkeypatch):
    """Several blocks of cases, and several parts of a block; ties go to the smaller record."""
    rng = random.Random(3)
    signs = [f"s{i}" for i in range(30)]
    listed = [(i, [rng.choice(signs) for _ in range(rng.randrange(0, 12))]) for i in range(80)]
    asked = [(i, rng.choice(signs)) for i in range(20) for _ in range(6)]
    records, symptoms = spark.createDataFrame(listed, "record_id long, keys array<string>"), spark.createDataFrame(asked, "case_id long, key string")
    scored = ranking.support(records.select("record_id", F.explode("keys").alias("key")), symptoms).withColumnRenamed("supporting", "score")
    monkeypatch.setattr(scoring, "WEIGHTS", 40)
    monkeypatch.setattr(scoring, "CELLS", 64)
    best = lambda f: sorted(map(tuple, ranking.top_per_case(f, "record_id").select("case_id", "rank", "record_id", "score", "n_matched").collect()))
    assert best(ranking.top_support(records.repartition(3), symptoms)) == best(scored)
    assert ranking.top_support(records, symptoms.limit(0)).count() == 0
    named = ranking.top_support(records.withColumn("record_id", F.col("record_id")), symptoms.withColumn("case_id", F.concat(F.lit("c"), "case_id")))
    assert named.count() == len(best(scored)) and named.schema["case_id"].dataType.simpleString() == "string"


def test_hamming_search_with_every_number_of_bands(spark, monkeypatch):
    rng = random.Random(8)
    words = [rng.getrandbits(64) for _ in range(30)]
    words += [w ^ sum(1 << b for b in rng.sample(range(64), k)) for w in words for k in (1, 4, 5)]
    rows = [(i, w - (1 << 64) if w >> 63 else w, rng.choice("ab")) for i, w in enumerate(words + words[:7])]
    near = [(x, y) for x in rows for y in rows if x[0] < y[0] and bin((x[1] ^ y[1]) % (1 << 64)).count("1") <= 4]
    frame = spark.createDataFrame(rows, "id long, bits long, label string")
    for m in (5, 6, 8):
        monkeypatch.setattr(dedup, "_bands", lambda words, radius, m=m: m)
        assert tuple(dedup.edge_counts(frame, "id", "bits", "label").first()) == (len(near), sum(x[2] != y[2] for x, y in near))
    monkeypatch.undo()
    assert [dedup._bands(n, 4) for n in (100, 1 << 13, 1 << 20, 1 << 26, 1 << 40)] == [5, 6, 6, 7, 8]


def test_text_hash_is_that_of_its_slices(spark):
    texts = ["", "a", "short text", "x" * 72, "é😀" * 100, "".join(chr(97 + i % 23) for i in range(1000)), None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sums = []
    for text in texts[:-1]:
        px = [0] * 72
        for i, c in enumerate(text):
            px[i * 72 // len(text)] += ord(c)
        sums.append((len(sums), px))
    want = {r[0]: r[1] for r in spark.createDataFrame(sums, "id long, px array<long>").select("id", T.dhash(F.col("px"))).collect()}
    assert {r[0]: r[1] for r in frame.select("id", dedup.text_dhash("text")).collect()} == want | {6: None}


def test_errata_are_the_fixed_ones(spark):
    title = media.SOURCE_ERRATA[0][1]
    frame = spark.createDataFrame([("downy-mildew-pseudoperonospora", "c", "s", ["a temporary UI grouping here", "b"], [(title, "u", "", "o", "d"), ("t", "u", "10.3390/app9204432", "o", "d")])],
                                  "slug string, category string, summary string, warnings array<string>, sources array<struct<title:string,url:string,doi:string,organization:string,publicationDate:string>>")
    got = media.corrected_records(frame, "slug").withColumn("sources", media.corrected(F.col("sources"))).first()
    assert got["category"] == "Oomycete pathogen" and got["warnings"][0].startswith("Pseudoperonospora is an oomycete") and got["warnings"][1] == "b"
    assert [tuple(s) for s in got["sources"]] == [(title, "https://doi.org/10.1093/jipm/pmaa008", "10.1093/jipm/pmaa008", "o", "2020-07-20"), ("t", "u", "10.3390/app9204432", "Applied Sciences (Cockson et al.)", "d")]


@pytest.mark.parametrize(("path", "want"), [
    ("Hemp_growth/c3/a.jpg", ("C3", "temporal-growth", "growth-series", "DS090-c3")), ("Hemp_water_stress/train/dry/ryb_C2_20240101.jpg", ("C2", "dry", "publisher-train", "DS090-C2")),
    ("Hemp_water_stress/test/wet/x.jpg", ("UNKNOWN", "wet", "publisher-test", "DS090-unknown")), ("Hemp_water_stress/other/wet/c5.png", ("C5", "", "growth-series", "")), ("w/yolo11x-cls.pt", ("UNKNOWN", "", "growth-series", "DS090-PUBLISHED-MODEL"))])
def test_paths(spark, path, want):
    c = F.lit(path)
    got = spark.range(1).select(paths.plant(c), paths.source_class(c), paths.source_split(c), paths.inventory(c)["group"]).first()
    assert tuple(got) == want


def test_lines_are_numbered_over_blocks_of_a_file(spark, tmp_path):
    lines = [("{broken %d" % i if i % 37 == 5 else '{"id": "%d"}' % i) if i % 11 else "" for i in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("{x\n")
    schema = t.StructType([t.StructField("id", t.StringType())])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        good, bad = documents.json_lines(spark, str(tmp_path / "*.jsonl"), schema)
        full = [x for x in lines if x]
        assert sorted((r["file"][-7], r["line"], r["content"]) for r in bad.collect()) == sorted([("a", i + 1, x) for i, x in enumerate(full) if x.startswith("{b")] + [("b", 1, "{x")])
        assert good.count() == sum(x.startswith('{"') for x in full) and bad.rdd.getNumPartitions() >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_last_batch_by_name_wins(spark, tmp_path):
    (tmp_path / "candidates-2.json").write_text('[{"id": "a", "v": "new"}, {"id": "c", "v": "c"}, {"id": "c", "v": "d"}]')
    (tmp_path / "candidates-1.json").write_text('[{"id": "a", "v": "old"}, {"id": "b", "v": "b"}]')
    (tmp_path / "other.json").write_text('[{"id": "z", "v": "z"}]')
    schema = t.StructType([t.StructField("id", t.StringType()), t.StructField("v", t.StringType())])
    assert sorted(map(tuple, documents.json_batches(spark, str(tmp_path / "candidates*.json"), schema, "id").collect())) == [("a", "new"), ("b", "b"), ("c", "d")]


def test_parts_of_files(spark):
    files = spark.createDataFrame([("a", bytearray(range(256)) * 10), ("b", bytearray()), ("c", bytearray(b"xyz"))], "path string, content binary")
    parts = documents.split_parts(files, 1000)
    assert Counter(r["path"] for r in parts.collect()) == {"a": 3, "b": 1, "c": 1}
    assert {r["path"]: bytes(r["content"]) for r in documents.joined_parts(parts).collect()} == {r["path"]: bytes(r["content"]) for r in files.collect()}
    with pytest.raises(Exception, match="digests differ: a"):
        documents.joined_parts(parts.where("path = 'a' and part < 2")).collect()


def test_names_below_a_folder(spark, tmp_path):
    for name in ("one/x.txt", "two/x.txt", "SHA256SUMS"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    assert [r[0].partition("  ")[2] for r in sinks.checksums(spark, f"file://{tmp_path}").collect()] == ["one/x.txt", "two/x.txt"]
    rows = spark.range(200).withColumn("k", F.lit("hot"))
    sinks.write_by_key(rows, str(tmp_path / "out"), "k", spread=4)
    assert spark.read.json(str(tmp_path / "out")).count() == 200


def test_partial_exports_are_refused(spark):
    assert validation.refuse_partial(spark.range(61)).count() == 61
    with pytest.raises(Exception, match="at least 61 rows"):
        validation.refuse_partial(spark.range(60)).collect()


def test_store_references_may_be_null_and_point_to_the_same_table(spark):
    cases = spark.createDataFrame([("c1",)], "case_id string")
    found = spark.createDataFrame([("m1", "c1", None, "image"), ("m2", "c1", "m1", "video"), ("m3", "c2", "m9", "sound")], "media_id string, case_id string, parent_media_id string, media_type string")
    got = validation.store_violations({"diagnostic_cases": cases, "case_media": found}, {"diagnostic_cases": "case_id", "case_media": "media_id"})
    assert sorted((r["row_key"], r["rule"]) for r in got.collect()) == [("m3", "case_id has no parent"), ("m3", "media_type is not allowed"), ("m3", "parent_media_id has no parent")]


def test_release_counts_name_every_place(spark):
    actual = spark.createDataFrame([(m, 5) for m in validation.RELEASE_METRICS if m != "totalReferenceImages"], "metric string, value long")
    labels = [x for xs in validation.RELEASE_METRICS.values() for x in xs]
    told = spark.createDataFrame([(x, 10 if "totalReferenceImages" in x or "totalPersisted" in x else 5) for x in labels], "label string, value long")
    got = validation.release_counts(actual, told)
    assert got.count() == len(labels) == 22 and got.where("not agrees").count() == 0
    assert validation.release_counts(actual, told.where("label <> 'manifest.evidenceSourceCount'")).where("not agrees").count() == 1


def test_packing_by_brute_force(spark):
    rng = random.Random(6)
    items = [(rng.choice("pq"), f"n{i}", rng.randrange(1, 50)) for i in range(60)]
    got = {(r["g"], r["name"]): r["bin"] for r in packing.pack(spark.createDataFrame(items, "g string, name string, size long"), ["g"], "name", "size", 3).collect()}
    for g in "pq":
        loads = [0, 0, 0]
        for _, name, size in sorted((x for x in items if x[0] == g), key=lambda x: (-x[2], x[1])):
            b = loads.index(min(loads))
            loads[b] += size
            assert got[g, name] == b


def test_deep_differences(spark):
    schema = "id string, l array<string>, s struct<a:int,b:string>"
    a = spark.createDataFrame([("1", ["x", "y"], (1, None)), ("2", ["x"], (1, "q")), ("3", [], None)], schema)
    b = spark.createDataFrame([("1", ["x", "y"], (1, None)), ("2", ["x"], (2, "q")), ("4", [], None)], schema)
    assert dict(map(tuple, merging.deep_diff(a, b, "id").collect())) == {"1": "same", "2": "changed", "3": "missing", "4": "unexpected"}


def test_calibration_of_sure_and_right_rows(spark):
    rows = spark.createDataFrame([(1.0, True)] * 3 + [(0.55, False)] * 3, "c double, ok boolean")
    assert coverage.calibration_error(rows, "c", "ok").first()[0] == pytest.approx(0.275)
    assert tuple(coverage.selective_accuracy(rows, "c", "ok", 0.9).first()) == (0.5, 1.0)
    assert coverage.selective_accuracy(rows, "c", "ok", 1.1).first()["accuracy"] is None


def test_orders_of_names(spark):
    """Case, accents and characters beyond the basic plane."""
    names = ["b", "A", "a", "B", "ä", "Z", "z", "éa", "ea", "eb", "\U0001f600", "\ufb00", "\ue000"]
    rows = spark.createDataFrame([(n, 1) for n in names], "name string, score int")
    got = [r["name"] for r in ordered.weakest(rows, "score", "name").collect()]
    assert [n for n in got if n.isascii() or n in "ä éa"] == ["a", "A", "ä", "b", "B", "ea", "éa", "eb", "z", "Z"]
    units = [r["sign"] for r in ordered.sign_vocabulary(rows.select(F.array("name").alias("signs")), "signs").collect()]
    assert units == sorted(names, key=lambda n: n.encode("utf-16-be")) and units.index("\U0001f600") < units.index("\ue000")
