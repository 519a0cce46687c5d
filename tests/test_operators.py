"""Operators, sources and sinks on small inputs."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as t

from sagebeam.functions import text as T
from sagebeam.operators import adjudication, dedup, merging, ordered, routing, splits, validation
from sagebeam.sources import documents, sinks


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scalars(spark):
    lit = F.lit
    assert one(spark, T.normalise(lit("\t Ab  "))) == "ab"
    assert one(spark, T.hex_bits(lit("dhash64:ffffffffffffffff"))) == -1
    assert one(spark, T.bits_hex(lit(255))) == "00000000000000ff"
    assert one(spark, T.hamming(lit(-1), lit(0))) == 64
    assert one(spark, T.cap(lit(85.0))) == 0.85 and one(spark, T.cap(lit(float("nan")))) is None
    assert one(spark, T.safe_id(lit("--a b/c--"))) == "a-b-c"
    assert one(spark, T.source_key(lit(""), lit(""), lit("t"), lit(None).cast("string"))) == "t|"
    assert one(spark, T.safe_path(lit("a/../b"))) is False and one(spark, T.safe_path(lit("a/b"))) is True
    assert one(spark, T.same_host(lit("X.org:80"), lit("x.org"))) is True
    assert one(spark, T.valid_url(lit("no url"))) is False
    assert one(spark, T.image_kind(F.unhex(lit("FFD8FFE000")))) == "jpg"
    assert one(spark, T.frame_times(lit(10.0))) == [0.5, 5.0, 9.5]
    assert one(spark, T.observation(lit('```json\n{"confidence": "HIGH", "matched": ["a", "b", "a"]}\n```'), F.array(lit("a")))).asDict() == {"confidence": "high", "summary": "", "matched": ["a"]}


def test_difference_hash(spark):
    px = [random.Random(3).randrange(100) for _ in range(72)]
    want = "".join("1" if px[9 * r + c] > px[9 * r + c + 1] else "0" for r in range(8) for c in range(8))
    got = spark.createDataFrame([(px,)], "p array<int>").select(T.dhash(F.col("p"))).first()[0]
    assert got % (1 << 64) == int(want, 2)


def test_hamming_edges_are_all_and_once(spark):
    rng = random.Random(5)
    words = [rng.getrandbits(64) for _ in range(40)]
    words += [w ^ sum(1 << b for b in rng.sample(range(64), k)) for w in words[:30] for k in (1, 3, 4, 5)]
    signed = [w - (1 << 64) if w >> 63 else w for w in dict.fromkeys(words)]
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(signed)], "id long, bits long")
    _, classes = dedup.hamming_classes(frame, "id", "bits")
    got = [(r["a"], r["b"], r["distance"]) for r in dedup.hamming_edges(classes).collect()]
    want = [(a, b, bin((a ^ b) % (1 << 64)).count("1")) for a in signed for b in signed if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 4]
    assert sorted(got) == sorted(want)


def test_components_of_a_chain_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100)] + [(5000, i) for i in range(3000, 4500)]  # and of a star, which is hot
    got = dict(map(tuple, dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100, **{i: 3000 for i in range(3000, 4500)}, 5000: 3000}


def test_merge_conflict_stops_and_later_values_win(spark):
    rows = spark.createDataFrame([("k", 1, "a", ["x"]), ("k", 2, None, ["y", "x"]), ("k", 3, "b", [])], "key string, at int, v string, l array<string>")
    got = merging.merge_keyed(rows, "key", "at", latest=["v"], lists=["l"]).first()
    assert got["v"] == "b" and got["l"] == ["x", "y"]
    with pytest.raises(Exception, match="conflicting values of v"):
        merging.merge_keyed(rows, "key", "at", latest=["v"], check=["v"]).collect()


def test_upsert_keeps_the_place(spark):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "id string, pos int, v string")
    new = spark.createDataFrame([("a", 9, "new"), ("c", 10, "new")], "id string, pos int, v string")
    got = {r["id"]: (r["pos"], r["v"]) for r in merging.upsert(base, new, "id", "pos").collect()}
    assert got == {"a": (1, "new"), "b": (2, "old"), "c": (10, "new")}


def test_adjudication(spark):
    cases = spark.createDataFrame(
        [("x", [("A", "a", 0.9, []), ("B", "b", 0.95, [])], [(False, ["m"], []), (True, ["m", "n"], [])], 0.1, ["e"])],
        "case_id string, candidates array<struct<canonical_id:string,canonical_label:string,calibrated_score:double,reasons:array<string>>>, checks array<struct<unresolved:boolean,missing_evidence:array<string>,contradictions:array<string>>>, open_set_unknown_score double, pass2_evidence_ids array<string>")
    policies = spark.createDataFrame([("POL-DEFAULT", ["*"], 0.8, "true", 0)], "policy_id string, canonical_ids array<string>, cap double, can_confirm string, ord int")
    evidence = spark.createDataFrame([("B", ["ev"])], "canonical_id string, evidence array<string>")
    got = adjudication.adjudicate(cases, policies, evidence).first()
    assert got["primary"]["canonical_id"] == "B" and got["final_confidence"] == 0.59 and got["provisional"] and got["requested_evidence"] == ["m", "n"]
    with pytest.raises(Exception, match="no controlled evidence"):
        adjudication.adjudicate(cases, policies, evidence.where("false")).collect()


def test_routing_order_and_hosts(spark):
    lane = lambda blob, host="", species="": one(spark, routing.lane(F.lit(blob), F.lit(host), F.lit(species)))
    assert lane("hemp female flower virus") == "04_VIRUS_VIROID_MOLECULAR"
    assert lane("hemp female flower") == "05_SEX_REPRODUCTIVE_MORPHOLOGY"
    assert lane("tomato mite", species="tomato") == routing.TRANSFER and lane("tomato mite") == routing.GATED
    assert lane("hemp mite", host="Cross-Crop") == routing.TRANSFER


def test_split_search_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice("xyz")) for g in "abcdef" for _ in range(rng.randrange(5, 30))]
    got = splits.choose_split(spark.createDataFrame(rows, "g string, k string"), "g", "k").first()

    def score(v, e):
        parts, out = {"t": [], "v": [], "e": []}, 0.0
        for g, k in rows:
            parts["v" if g == v else "e" if g == e else "t"].append(k)
        for p, target in (("t", 0.6), ("v", 0.2), ("e", 0.2)):
            n = len(parts[p])
            out += sum(abs(parts[p].count(k) / n - sum(x == k for _, x in rows) / len(rows)) for k in "xyz") + 0.5 * abs(n / len(rows) - target)
        return round(out, 6)

    best = min((score(v, e), sorted(set("abcdef") - {v, e}), v, e) for v in "abcdef" for e in "abcdef" if v != e)
    assert (got["score"], got["validation_group"], got["test_group"]) == (best[0], best[2], best[3])


def test_split_search_by_tiles(spark, monkeypatch):
    """Groups alike in cost and many ties: blocks, tiles and bounds give the row that all pairs at once give."""
    rng = random.Random(7)
    shapes = [[rng.choice("xyz") for _ in range(rng.randrange(3, 12))] for _ in range(6)]
    rows = [(g, k) for g in range(40) for k in shapes[g % 6]] + [(None, "x"), (-1, None), (-1, "x")]
    frame = spark.createDataFrame(rows, "g long, k string").repartition(3)
    want = splits.choose_split(frame, "g", "k").first()
    for name, value in (("SEEDS", 3), ("BLOCK", 4), ("CELLS", 60)):
        monkeypatch.setattr(splits, name, value)
    assert splits.choose_split(frame, "g", "k").first() == want
    assert splits.choose_split(frame.where("g < 2"), "g", "k").count() == 1 and splits.choose_split(frame.where("g in (1, 2)"), "g", "k").count() == 0


def test_rate_limit_stream_and_batch_agree(spark, tmp_path):
    from sagebeam.streaming import rate_limit

    rng = random.Random(4)
    events = sorted((rng.choice("ab"), i, float(rng.randrange(5000))) for i in range(120))
    frame = spark.createDataFrame(events, "key string, event_id long, seconds double")
    batch = {r["event_id"]: (r["window_start"], r["count"], r["accepted"]) for r in ordered.rate_limited(frame, "key", "seconds", "event_id", 600, 3).collect()}
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = rate_limit.limited(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), 600, 3).writeStream.format("memory").queryName("limited").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {r["event_id"]: (r["window_start"], r["count"], r["accepted"]) for r in spark.table("limited").collect()} == batch


def test_validators(spark):
    rows = spark.createDataFrame([(1, "DS-001", "https://x.org"), (2, " ", "x"), (3, None, None)], "k int, id string, url string")
    got = validation.violations(rows, "d", "k", [*validation.required("id"), validation.is_url("url")])
    assert sorted((r["row_key"], r["rule"]) for r in got.collect()) == [("2", "id is required"), ("2", "url is no URL"), ("3", "id is required"), ("3", "url is no URL")]
    with pytest.raises(ValueError, match="id is required"):
        validation.require_none(got)


def broken(spark, rules, schema, good, **wrong):
    """The rules that a good row fails with the wrong values; none without them."""
    assert validation.violations(spark.createDataFrame([good], schema), "d", "key", rules).count() == 0
    return {r["rule"] for r in validation.violations(spark.createDataFrame([good | wrong], schema), "d", "key", rules).collect()}


def test_snapshot_rules_are_those_of_the_reference(spark):
    names = "sheetRow order dataset version expectedPackage repositoryChecksum criticalNotes driveFolderId".split()
    good = dict.fromkeys(names, "x") | {"key": "1", "datasetId": "DS-001", "canonicalSource": "https://x.org/a", "license": "CC BY", "rightsStatus": "clear", "destination": "01_RAW_OPEN/a", "acquisitionStatus": "done", "integrityStatus": "verified"}
    schema = ", ".join(f"`{k}` string" for k in good)
    for rights in ("noncommercial", "ShareAlike", "license verify", "per-item", "gated"):
        assert broken(spark, validation.acquisition_rules(), schema, good, rightsStatus=rights) == {"open lane with restricted rights"}
    assert broken(spark, validation.acquisition_rules(), schema, good, sheetRow=" ", acquisitionStatus="runtime blocked") == {"sheetRow is required", "blocked at run time but complete"}
    good = dict.fromkeys("name domain modality primaryTask license academicUse rawRedistribution publicModelDeployment".split(), "x") | {"key": "1", "id": "DS-001", "cannabisSpecific": "NO", "priority": "P1", "sourceUrl": "https://x.org", "provenanceStatus": "known"}
    assert broken(spark, validation.source_rules(), ", ".join(f"`{k}` string" for k in good), good, academicUse="Unknown", domain=None, cannabisSpecific="MAYBE") == {"domain is required", "cannabisSpecific is not allowed", "unknown rights need a look at provenance"}
    good = dict.fromkeys("source acquisitionRule notes".split(), "x") | {"key": "1", "requestId": "PERM-001", "datasetId": "DS-001", "priority": "P0", "status": "SENT", "requestedDate": "2026-01-01", "responseDate": None, "contact": {"nameOrOrganization": "n"}} | dict.fromkeys(("requestedAssets", "requestedMetadata", "rightsRequested"), ["a"])
    schema = ", ".join(f"`{k}` " + ("array<string>" if isinstance(v, list) else "struct<nameOrOrganization: string>" if isinstance(v, dict) else "string") for k, v in good.items())
    assert broken(spark, validation.permission_rules(), schema, good, requestId="PERM-1", status="REQUEST_DRAFT_READY", rightsRequested=[], contact={"nameOrOrganization": " "}) == {"requestId has the wrong form", "a draft has no request date", "rightsRequested has fewer than 1 entries", "contact.nameOrOrganization is required"}
    good = dict.fromkeys("id issue_slug source_article caption creator".split(), "x") | {"key": "1", "image_url": "https://www.mdpi.com/a.png", "license": "CC BY", "intended_use": "reference-only", "content_type": "image/png", "byte_size": 9}
    schema = ", ".join(f"`{k}` " + ("long" if k == "byte_size" else "string") for k in good)
    assert broken(spark, validation.persistence_rules(), schema, good, image_url="http://www.mdpi.com/a.png", byte_size=20_000_001, caption="") == {"caption is required", "image_url is not on an allowed host", "byte_size is not from 1 to 20000000"}


def test_transfer_policy(spark):
    rules = {f"DS-{n}": {"role": ["r"], "rules": ["Overlap double-count 64 sourceGroupId one split white-background natural-background hard negatives harmful-insect"], "beneficialClasses": ["lacewing", "hoverfly", "lady beetle"]} for n in range(137, 147)}
    fixed = {"cannabisCausalGroundTruth": False, "preserveOriginalSourceLabels": True, "requireCannabisSpecificConfirmationForCannabisEtiology": True, "requireSha256AndPerceptualDedupBeforeTraining": True, "allowIndependentSampleInflationFromDerivatives": False, "allowedUses": list("abcd"), "forbiddenUses": list("abcd")}
    good = {"key": "1", "policyVersion": "1", "scope": {"datasetIds": list(rules)}, "invariants": fixed, "datasetRules": rules}
    of = ", ".join(f"{k}: " + ("array<string>" if isinstance(v, list) else "boolean") for k, v in fixed.items())
    schema = f"key string, policyVersion string, scope struct<datasetIds: array<string>>, invariants struct<{of}>, datasetRules map<string, struct<role: array<string>, rules: array<string>, beneficialClasses: array<string>>>"
    wrong = {k: v for k, v in rules.items() if k != "DS-139"} | {"DS-142": rules["DS-142"] | {"rules": ["x"]}}
    assert broken(spark, validation.transfer_rules(), schema, good, datasetRules=wrong, invariants=fixed | {"cannabisCausalGroundTruth": True}) == {"DS-139 role missing", "DS-139 rules missing", "DS-142 rules incomplete", "invariants.cannabisCausalGroundTruth is not false"}


def test_zip_inventory_has_no_depth_limit(spark):
    data = b"x"
    for depth in range(12):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("in.zip" if depth else "a.csv", data)
        data = out.getvalue()
    frame = spark.createDataFrame([("o.zip", bytearray(data))], "path string, content binary")
    assert documents.zip_inventory(frame).agg({"depth": "max"}).first()[0] == 11


def test_zip_inventory(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/p.png", b"123")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("a.csv", b"x")
    frame = spark.createDataFrame([("o.zip", bytearray(outer.getvalue()))], "path string, content binary")
    got = {(r["path"], r["member"]): (r["is_image"], r["is_annotation"], r["depth"]) for r in documents.zip_inventory(frame).collect()}
    assert got == {("o.zip", "in.zip"): (False, False, 0), ("o.zip!in.zip", "deep/p.png"): (True, False, 1), ("o.zip", "a.csv"): (False, True, 0)}
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../x", b"")
    with pytest.raises(Exception, match="unsafe member"):
        documents.zip_inventory(spark.createDataFrame([("b.zip", bytearray(bad.getvalue()))], "path string, content binary")).collect()


def test_json_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"records": [{"id": "x", "tags": ["1", "2"]}, {"id": "y"}]}')
    schema = t.StructType([t.StructField("id", t.StringType()), t.StructField("tags", t.ArrayType(t.StringType()))])
    rows = documents.json_records(spark, str(tmp_path / "a.json"), schema)
    assert [r["id"] for r in rows.orderBy("id").collect()] == ["x", "y"]
    (tmp_path / "b.jsonl").write_text('{"id": "x"}\n\n{broken\n')
    good, bad = documents.json_lines(spark, str(tmp_path / "b.jsonl"), schema)
    assert [r["id"] for r in good.collect()] == ["x"] and [r["content"] for r in bad.collect()] == ["{broken"]
    sinks.write_csv(rows.orderBy("id").coalesce(1), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_text() == '"id","tags"\n"x","1 | 2"\n"y",""\n'
    sinks.write_by_key(rows, str(tmp_path / "lanes"), "id")
    assert sorted(p.name for p in (tmp_path / "lanes").glob("_key=*")) == ["_key=x", "_key=y"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "z.txt").write_text("z")
    assert sinks.checksums(spark, str(tmp_path / "f")).first()[0].endswith("  z.txt")
