"""Two stages of rewriting, the postings that many probes share, and the questions that any change must still answer."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar import config
from lodestar.operators import retrieval
from lodestar.plans import engine, operations, rewrite
from lodestar.streaming import questions

from .test_questions import INDEX, kb


class Says:
    """Answers the first stage with one object, the second with another, and keeps what it was asked."""

    def __init__(self, first, second):
        self.first, self.second, self.asked = first, second, []

    def generate(self, prompt):
        self.asked.append(prompt)
        if "probe_queries" in prompt:
            return json.dumps(self.first)
        return json.dumps(self.second) if "final_rewritten_queries" in prompt else "Beta and Gamma"


FIRST = {"intent": "list", "target_columns": ["EV Supply Chain Role"], "probe_queries": ["battery pack suppliers"], "explicit_filters": {"Updated Location": "Georgia"}, "is_broad": "no"}
SECOND = {"final_rewritten_queries": ["battery pack companies", "quantum widget gizmos"], "confidence": "high", "mapped_user_phrases": [{"user_phrase": "packs", "kb_supported_terms": ["battery pack", "gizmo"], "confidence": "high"}]}


def test_first_stage():
    got = rewrite.first("pack makers", INDEX, Says(FIRST, {}))
    assert got.queries == ["pack makers", "battery pack suppliers"] and got.targets == ["ev_supply_chain_role"] and got.filters == {rewrite.SCOPE: "Georgia"}
    assert got.intent == "list" and got.exhaustive
    failed = rewrite.first("pack makers", INDEX, Says({"intent": "list"}, {}))
    assert failed.queries[0] == "pack makers" and failed.confidence == "low" and failed.warnings == ["no probes from the generator"]
    assert [rewrite.intent_of(x, q) for x, q in ((["odd", "compare"], ""), ("odd", "How many?"), (None, "any supplier"), (3, "who"))] == ["compare", "count", "supplier_discovery", "other"]


def test_second_stage_keeps_to_found_terms():
    begun = rewrite.first("pack makers", INDEX, Says(FIRST, {}))
    got = rewrite.second("pack makers", INDEX, begun, {"battery pack": ["ev_supply_chain_role"], "companies": ["company"]}, Says(FIRST, SECOND))
    assert got.queries == ["pack makers", "battery pack companies"] and got.confidence == "low" and "query: quantum widget gizmos" in got.warnings
    assert got.mapped[0].terms == ("battery pack",) and got.targets == ["ev_supply_chain_role"]
    clean = SECOND | {"final_rewritten_queries": ["battery pack companies"]}
    assert rewrite.second("pack makers", INDEX, begun, {"battery pack": [], "companies": []}, Says(FIRST, clean)).confidence == "high"
    assert rewrite.second("pack makers", INDEX, begun, {}, Says(FIRST, clean | {"confidence": "high"})).confidence == "low"
    assert rewrite.second("pack makers", INDEX, begun, {"x": []}).queries == begun.queries


def test_engine_rewrites_in_two_stages(spark):
    said = Says(FIRST, SECOND)
    e = engine.Engine(kb(spark), config.Settings(most_probes=2, least_rows=1), said)
    a = e.answer("Show pack makers")
    assert a.queries[:2] == ["Show pack makers", "battery pack companies"] and a.filters.get("ev_supply_chain_role") == ["Battery Pack"]
    assert len(a.evidence) == 2 and a.method == "two stages + filters" and any("battery pack" in p for p in said.asked[1:])
    weak = engine.Engine(kb(spark), config.Settings(most_probes=2, least_rows=50), Says(FIRST, SECOND)).answer("Show pack makers")
    assert weak.confidence == "low" and "weak retrieval" in weak.warnings
    assert engine.Engine(kb(spark)).answer("How many companies?").method == "whole table"


def test_a_generators_filters_count_only_where_no_other_does(spark):
    first = FIRST | {"explicit_filters": {"company": "Delta"}}
    second = {"final_rewritten_queries": [], "confidence": "low", "mapped_user_phrases": []}
    e = engine.Engine(kb(spark), config.Settings(most_probes=2), Says(first, second))
    assert e.answer("zzz qqq").filters == {"company": ["Delta"]}
    assert e.answer("Show all Tier 1/2 suppliers").filters == {"category": ["Tier 1/2"]}


def test_probes_share_their_postings(spark):
    rows = [(1, "a b b c"), (2, "b c"), (3, None), (4, ""), (5, "c c d"), (6, "a d e")]
    docs, probes = spark.createDataFrame(rows, "id int, body string"), ["b a", "d d c", "zzz", ""]
    kept = retrieval.keep(docs, "id", F.col("body"))
    got = sorted(tuple(r) for r in retrieval.bm25_each(kept, "id", probes, 2).collect())
    alone = [(n, r.id, i) for n, p in enumerate(probes) for i, r in enumerate(retrieval.bm25(docs, "id", F.col("body"), p, 2).collect())]
    assert kept.n == 6 and got == sorted(alone)
    got = sorted(tuple(r) for r in retrieval.overlap_each(docs, probes, ["body"], "id", 2).collect())
    assert got == sorted((n, r.id, i) for n, p in enumerate(probes) for i, r in enumerate(retrieval.overlap(docs, p, ["body"], "id", 2).collect()))
    none = retrieval.keep(docs.limit(0), "id", F.col("body"))
    assert retrieval.bm25_each(none, "id", probes, 2).count() == 0


@pytest.mark.parametrize(("q", "kind", "filters"), [
    ("Show all Tier 1/2 suppliers in Georgia", "exhaustive_list", {"category": ["Tier 1/2"]}), ("Which roles are single point of failure?", "spof", {}),
    ("Show Battery Cell or Battery Pack companies", None, {"ev_supply_chain_role": ["Battery Cell", "Battery Pack"]}), ("Thermal Management suppliers", None, {}),
    ("Which county has the highest total employment?", "aggregate_sum", {}),
])
def test_questions_that_must_hold(spark, q, kind, filters):
    """Tiers never filter roles, what names the whole table filters no place, and analytical words filter nothing."""
    a = engine.Engine(kb(spark), config.Settings(most_probes=2)).answer(q)
    assert {c: sorted(v) for c, v in a.filters.items()} == filters and a.evidence or q.startswith("Thermal")
    assert kind is None or a.operation == kind
    assert not any(operations.kind_of(v) == "tier" for v in a.filters.get("ev_supply_chain_role", []))


def test_group_column_by_values(spark):
    e = engine.Engine(kb(spark).drop("category"))
    assert e.group_column("sum by battery") == "ev_supply_chain_role" and e.group_column("sum by nothing") is None


def test_streams_are_answered_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(questions, "SLICE", 2)
    spark.createDataFrame([("How many companies?",)] * 3, "question string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("question string").json(str(tmp_path / "in"))
    q = questions.answer_stream(stream, engine.Engine(kb(spark)), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 3 and out.select("slice").distinct().count() == 2
