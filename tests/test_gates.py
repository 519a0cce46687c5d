"""Gates as a table of rules: every kind, missing records, and plans that do not grow."""

from __future__ import annotations

import pytest

from sagebeam.functions import keywords
from sagebeam.operators import gates

FACET = "record_id string, scopes array<string>, field string, items array<string>, number double"


def facets(spark):
    return spark.createDataFrame([("a", ["slug:a", "all"], "t", ["Red Leaf", None, "tip"], None), ("b", ["slug:b", "category:c", "all"], "t", None, None), ("b", ["slug:b", "all"], "cap", [], 0.7), ("a", ["slug:a", "all"], "cap", [], None)], FACET)


@pytest.mark.parametrize(("scope", "field", "kind", "value", "number", "want"), [
    ("all", "t", "holds", "red leaf", None, {"b"}), ("all", "t", "holds", "leaf tip", None, {"b"}), ("all", "t", "lacks", "leaf", None, {"a"}), ("all", "t", "matches", "r.d.*tip", None, {"b"}), ("all", "t", "matches_case", "Red", None, {"b"}),
    ("all", "t", "lists", "tip", None, {"b"}), ("all", "t", "none", "tip", None, {"a"}), ("all", "t", "some", "Lea", None, {"b"}), ("all", "t", "is", "Red Leaf", None, {"b"}), ("all", "t", "size", None, 2.0, {"b"}),
    ("all", "t", "least", None, 1.0, {"b"}), ("all", "cap", "most", None, 0.65, {"a", "b"}), ("all", "cap", "most", None, 0.7, {"a"}), ("slug:x", "t", "is", "y", None, {None}), ("slug:a", "other", "is", "y", None, {None}), ("category:none", "t", "is", "y", None, set()),
    ("category:c", "t", "least", None, 0.0, set())])
def test_kinds(spark, scope, field, kind, value, number, want):
    rules = spark.createDataFrame([("r", scope, field, kind, value, number)], gates.RULE)
    assert {r["record_id"] for r in gates.violations(facets(spark), rules).collect()} == want


def test_unknown_kinds_stop(spark):
    with pytest.raises(Exception, match="no such kind"):
        gates.violations(facets(spark), spark.createDataFrame([("r", "all", "t", "likes", "x", None)], gates.RULE)).collect()


def test_thousands_of_rules_and_no_larger_plan(spark, monkeypatch):
    few, many = ([(f"r{i}", "all", "t", kind, f"w{i}x", None) for i in range(n) for kind in ("holds", "lacks")] for n in (2, 3000))
    of = lambda rows: gates.violations(facets(spark), spark.createDataFrame(rows, gates.RULE))
    lines = [len(of(rows)._jdf.queryExecution().optimizedPlan().toString().splitlines()) for rows in (few, many)]
    assert lines[0] == lines[1] and of(many).count() == 6000
    # Several automata share the terms when one would be too large.
    monkeypatch.setattr(keywords, "TABLE", 40)
    rules = [(f"r{w}", "all", "t", "lacks", w, None) for w in ("tip", "leaf", "red leaf", "stem", *(f"word{i}" for i in range(40)))]
    assert sorted(r["rule"] for r in of(rules).collect()) == ["rleaf", "rred leaf", "rtip"]


def test_every_record_of_the_catalogue_gates_is_known(spark):
    rules = gates.catalogue_rules(spark).collect()
    assert {r["kind"] for r in rules} <= set(gates.KINDS) and len(rules) == len({(r["rule"], r["scope"]) for r in rules})
    empty = spark.createDataFrame([], "slug string, category string, reviewStatus string, scientificName string, photoOnlyMaxConfidence double, confirmation array<string>, warnings array<string>, lookAlikes array<string>, media array<struct<id:string,trainingEligible:boolean,useLimitations:array<string>>>, sources array<struct<doi:string,url:string>>")
    assert gates.violations(gates.catalogue_facets(empty), gates.catalogue_rules(spark)).where("record_id is null").count() == sum(r["scope"].startswith("slug:") for r in rules)


def test_terms_meet_only_the_rules_that_they_break(spark):
    """Rows that lack a word are not paired with the rule that asks for it; a rule told twice, an empty word and none at all count as they are."""
    rows = [(f"r{i}", "all", "t", "lacks", f"w{i}x", None) for i in range(500)] + [("tip", "all", "t", "lacks", "tip", None)] * 2 + [("none", "all", "t", "lacks", None, None), ("empty", "all", "cap", "lacks", "", None)]
    found = gates.violations(facets(spark), spark.createDataFrame(rows, gates.RULE))
    assert sorted((r["record_id"], r["rule"]) for r in found.collect()) == [("a", "empty"), ("a", "none"), ("a", "tip"), ("a", "tip"), ("b", "empty"), ("b", "none")]
    nodes, paired = [found._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        below = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if node.nodeName().endswith("QueryStage") else None
        nodes += [below] if below else [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in node.nodeName() and "met_by" in node.toString().split("\n")[0]:
            paired.append(node.metrics().apply("numOutputRows").value())
    assert paired and max(paired) < 20
