import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from lodestar import config, service
from lodestar.operators import predicates, retrieval, schema
from lodestar.operators.schema import Column
from lodestar.plans import engine, matcher, operations, rewrite
from lodestar.sources import files, upsert, xlsx
from lodestar.streaming import questions

INDEX = {
    "category": Column("category", "exact", True, ("OEM", "Tier 1", "Tier 1/2", "Tier 2", "Tier 2/3")),
    "ev_supply_chain_role": Column("ev_supply_chain_role", "exact", True, ("Battery Cell", "Battery Pack", "Thermal Management", "Tier 1 Automotive Components")),
    "product_service": Column("product_service", "exact", True, ("Battery Modules", "EV Charging Stations")),
    "updated_location": Column("updated_location", "partial", True, ("Atlanta, Fulton County", "Savannah, Chatham County"), ("Atlanta", "Chatham County", "Fulton County", "Savannah")),
    "company": Column("company", "exact", True, ("Acme Corp", "Beta Industries")),
    "employment": Column("employment", "numeric", False),
}


@pytest.mark.parametrize(("q", "kind", "exhaustive"), [
    ("Which roles are single point of failure?", "spof", True), ("Show all Tier 1/2 suppliers in Georgia", "exhaustive_list", True), ("Which county has the highest total employment?", "aggregate_sum", True),
    ("How many Battery Cell companies are there?", "count", True), ("Thermal Management suppliers", "none", False),
])
def test_operations(q, kind, exhaustive):
    got = operations.detect(q)
    assert (got["operation"], got["exhaustive"]) == (kind, exhaustive)


def test_phrases_and_columns():
    assert operations.is_analytical_phrase("single point of failure") and operations.is_analytical_phrase("highest") and not operations.is_analytical_phrase("Battery Cell")
    assert [matcher.is_tier_column(c) for c in ("category", "ev_supply_chain_role", "product_service")] == [True, False, False]
    assert [operations.kind_of(p) for p in ("highest", "Battery Cell", "tier 1/2")] == ["analytical", "product_component", "tier"]
    assert matcher.is_column_name("category", INDEX) and matcher.is_column_name("ev supply chain role", INDEX) and not matcher.is_column_name("Battery Cell", INDEX)
    assert operations.fits_column("Tier 1", "category") and not operations.fits_column("Tier 1", "ev_supply_chain_role") and not operations.fits_column("highest", "category")
    assert operations.fits_column("Battery Cell", "ev_supply_chain_role") and not operations.fits_column("Battery Cell", "company") and operations.fits_column("Acme", "company")


def test_slash_anchor_wins():
    values = ["Tier 1/2", "Tier 1", "Tier 2", "Tier 2/3"]
    kinds = dict(zip(values, ["exact", "tier_exact", "tier_exact", "tier_exact"]))
    assert matcher.without_conflicts(values, kinds, "Show all Tier 1/2 suppliers") == ["Tier 1/2"]
    assert matcher.match("Show all Tier 1/2 suppliers in Georgia", INDEX).filters == {"category": ["Tier 1/2"]}


def test_resolver():
    cell = matcher.resolve("Show Battery Cell companies", INDEX)
    assert cell.filters == {"ev_supply_chain_role": ["Battery Cell"]}
    tier = matcher.resolve("Show all Tier 1/2 suppliers", INDEX)
    assert tier.filters["category"] == ["Tier 1/2"] and "ev_supply_chain_role" not in tier.filters
    assert matcher.resolve("Thermal Management suppliers", INDEX).filters == {"ev_supply_chain_role": ["Thermal Management"]}
    assert not matcher.resolve("Show all companies doing power electronics", INDEX).filters
    assert set(cell.to_debug_dict()) == {"perfect", "candidate", "rejected", "deterministic_filters"}
    assert matcher.match("companies in Fulton County making foo", INDEX).unmatched == ["making", "foo"]


def test_intents():
    assert operations.detect_intent("largest companies") == {"type": "rank", "n": 1, "direction": "desc"}
    assert operations.effective_intent("highest employment")["type"] == "rank" and operations.effective_intent("highest employment", True)["type"] == "exhaustive_list"
    assert [operations.support_level(*x) for x in ((0, False, False), (3, True, False), (3, True, True), (1, True, False), (0, True, False), (5, False, False))] == ["Not Supported", "Fully Supported", "Mostly Supported", "Partially Supported", "Weakly Supported", "Weakly Supported"]


@pytest.mark.parametrize("said", ['{"a": 1, "b": 2}', '```json\n{"a": 1, "b": 2}\n```', 'Sure! {"a": 1, "b": 2} done', '<think>{x}</think> {"a": 1, "b": 2}'])
def test_json_is_found(said):
    assert rewrite.first_object(said) == {"a": 1, "b": 2}


@pytest.mark.parametrize("said", ["", "[1]", "none", "{broken"])
def test_json_is_refused(said):
    assert rewrite.first_object(said) is None


def test_rewriting_keeps_to_known_words():
    class Says:
        def generate(self, prompt):
            return json.dumps({"final_rewritten_queries": ["battery cell makers", "unrelated quantum widgets"], "confidence": "high", "mapped_user_phrases": []})

    got = rewrite.queries("battery cell companies", INDEX, ["makers"], Says())
    assert got == ["battery cell companies", "battery cell makers"]
    assert rewrite.queries("battery cell", INDEX, [])[0] == "battery cell" and rewrite.probes("battery cell", INDEX)[0] == "battery cell"


def kb(spark):
    rows = [(0, "Acme", "Tier 1", "Atlanta, Fulton County", "Battery Cell", 100.0), (1, "Beta", "Tier 1/2", "Savannah, Chatham County", "Battery Pack", 300.0), (2, "Gamma", "Tier 1/2", "Marietta, Fulton County", "Battery Pack", 250.0), (3, "Delta", "OEM", "Rome, Floyd County", None, None)]
    return spark.createDataFrame(rows, "_row_id int, company string, category string, updated_location string, ev_supply_chain_role string, employment double")


def test_engine(spark):
    e = engine.Engine(kb(spark), config.Settings(most_probes=2))
    best = e.answer("Which county has the highest total employment?")
    assert best.operation == "aggregate_sum" and "Fulton County" in best.evidence[0] and "350" in best.evidence[0]
    assert e.answer("How many Tier 1/2 companies?").answer == "There are 2."
    alone = e.answer("Which roles are single point of failure?")
    assert alone.operation == "spof" and len(alone.evidence) == 1 and "Acme" in alone.evidence[0]
    listed = e.answer("Show all Tier 1/2 suppliers")
    assert len(listed.evidence) == 2 and listed.filters == {"category": ["Tier 1/2"]}
    assert "Beta" in e.answer("largest companies").evidence[0]
    assert e.answer("battery pack makers near nowhere").evidence
    assert e.answers(["How many companies?", ""]).count() == 2
    assert e.vocabulary(kb(spark))


def test_answers_come_from_the_generator_with_a_risk(spark):
    class Says:
        def generate(self, prompt):
            return "<think>hm</think>Fulton County has the highest" if "Evidence" in prompt else "none"

    a = engine.Engine(kb(spark), config.Settings(most_probes=1), Says()).answer("Which county has the highest total employment?")
    assert a.answer == "Fulton County has the highest" and a.risk in ("Low", "Medium", "High")
    assert engine.Engine(kb(spark)).answer("How many companies?").risk == "Low"


def test_values_of_long_columns_filter_as_those_of_short_ones(spark, monkeypatch):
    asked = ("How many Tier 1/2 companies?", "How many companies in Savannah, Chatham County?", "Show Beta", "Which county has the highest total employment?")
    short = [engine.Engine(kb(spark), config.Settings(most_probes=1)).answer(q) for q in asked]
    monkeypatch.setattr(schema, "MOST_VALUES", 1)
    long = [engine.Engine(kb(spark), config.Settings(most_probes=1)).answer(q) for q in asked]
    assert [(a.operation, a.answer, a.filters) for a in short[1:]] == [(a.operation, a.answer, a.filters) for a in long[1:]]
    assert long[0].answer == "There are 2."


def test_filters(spark):
    df, match = kb(spark), {"category": "exact", "company": "exact", "updated_location": "partial"}
    assert predicates.filtered(df, {"category": ["tier 1"]}, match).count() == 1
    assert predicates.filtered(df, {"category": ["tier"]}, match).count() == 3
    assert predicates.filtered(df, {"absent": ["x"], "category": [" "]}, match).count() in (0, 4)
    assert predicates.best_single(df, {"company": ["zzz"]}, match)[1] == {}
    assert predicates.merged({"a": ["X"]}, {"a": ["x", "Y"], "__m": ["z"], "b": "s"}, ["a", "b"]) == {"a": ["X", "Y"], "b": ["s"]}
    assert predicates.entity_search(df, {}).count() == 0


def test_fusion_does_not_depend_on_the_order_of_lists(spark):
    def run(orders):
        lists = [spark.createDataFrame([(n, i, r) for r, i in enumerate(ids)], "list int, id int, rank int") for n, ids in enumerate(orders)]
        return {r.id: round(r.score, 12) for r in retrieval.rrf(lists, "id").collect()}

    a, b, c = [1, 2, 3], [3, 1], [5]
    assert run([a, b, c]) == run([c, a, b])


def test_sheets(spark, tmp_path):
    path = str(tmp_path / "final auto.xlsx")
    raw = spark.createDataFrame([("Acme", "1,200", None), (None, "3", "x"), ("B & <C>", "n/a", " y ")], "Company string, Employment string, `EV / Battery Relevant` string")
    xlsx.write(path, {"data": raw, "more": raw.limit(1)})
    assert files.find([str(tmp_path)], preferred=("auto",)).name == "final auto.xlsx"
    got = files.knowledge(spark, path).orderBy("_row_id").collect()
    assert [(r._row_id, r.company, r.employment, r.ev_battery_relevant) for r in got] == [(0, "Acme", 1200.0, "Unknown"), (1, "B & <C>", None, "Yes")]
    with pytest.raises(ValueError):
        xlsx.write(str(tmp_path / "x.xlsx"), {"data": raw}, 2)
    files.debug_report(raw, str(tmp_path / "debug.xlsx"))
    asked = spark.createDataFrame([("1", "a", " Q? ", "yes"), ("2", "b", "nan", ""), ("x", "c", None, "")], "Num string, `Use case` string, Question string, `Human answer` string")
    assert [tuple(r) for r in files.questions(asked).collect()] == [(1, "a", "Q?", "yes")]


def test_upsert(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v string"
    upsert.upsert(spark.createDataFrame([(1, "a"), (2, "b")], schema), path, ["k"])
    upsert.upsert(spark.createDataFrame([(2, "c"), (3, "d")], schema), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(upsert.current(spark, path)).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    upsert.upsert(spark.createDataFrame([(9, "z")], schema), path, ["k"], recreate=True)
    assert spark.read.parquet(upsert.current(spark, path)).count() == 1


def test_streams_and_service(spark, tmp_path):
    e = engine.Engine(kb(spark), config.Settings(most_probes=1))
    spark.createDataFrame([("How many companies?",)], "question string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("question string").json(str(tmp_path / "in"))
    q = questions.answer_stream(stream, e, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r.answer for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["There are 4."]
    server = service.server(e, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"
    assert json.loads(urllib.request.urlopen(f"{at}/health").read()) == {"status": "ok"}
    body = urllib.request.Request(f"{at}/ask", data=b'{"question": "How many companies?"}', method="POST")
    assert json.loads(urllib.request.urlopen(body).read())["answer"] == "There are 4."
    assert urllib.request.urlopen(f"{at}/stream?question=How+many+companies").read().decode().endswith("data: [DONE]\n\n")
    server.shutdown()


def test_event_windows(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) ts, 'view' event_type, 1.0D value from range(10)")
    events.write.parquet(str(tmp_path / "e"))
    q = questions.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("windows").collect()) == [5, 5]


def test_settings():
    assert config.Settings.from_env(env={"LODESTAR_TOP_K": "3", "LODESTAR_STRICT": "True", "LODESTAR_THRESHOLD": "0.5"}) == config.Settings(top_k=3, strict=True, threshold=0.5)
    assert F.lit(1) is not None
