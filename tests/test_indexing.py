from lodestar import config
from lodestar.operators import chunks, retrieval
from lodestar.plans import engine, operations, rewrite
from lodestar.sources import indexing, xlsx

from .test_questions import INDEX, kb


def test_index_job_counts_and_upserts(spark, tmp_path):
    path, table = str(tmp_path / "index"), kb(spark)
    first = indexing.index(table, path, recreate=True)
    assert (first.chunks, first.vector_size, first.model) == (20, 256, "hashed words")
    again = indexing.index(table.where("_row_id < 2"), path)
    held = spark.read.parquet(again.children)
    assert again.chunks == 10 and held.count() == 20 and held.select("chunk_id").distinct().count() == 20
    assert spark.read.parquet(again.parents).count() == 4
    assert indexing.index(table.limit(0), str(tmp_path / "none")).vector_size == 0


def test_chunks_as_sheets_and_columns(spark, tmp_path):
    parents = chunks.parents(kb(spark))
    children = chunks.children(parents)
    sheets = chunks.exported(parents, children)
    assert sheets["parents"].columns == ["record_id", "source_row_id", "parent_chunk_text"] and len(sheets["children"].columns) == 4
    flat = chunks.payload(children).where("chunk_type = 'identity' and source_row_id = 0").first()
    assert (flat.company, flat.category, flat.employment) == ("Acme", "Tier 1", None)
    indexing.export(kb(spark), str(tmp_path / "chunks.xlsx"))
    assert xlsx.read(spark, str(tmp_path / "chunks.xlsx")).count() == 4


def test_vectors_join_the_lists(spark):
    settings = config.Settings(most_probes=1, threshold=0.1)
    e = engine.Engine(kb(spark), settings, embed=retrieval.embed)
    assert {r.company for r in e.retrieve("Battery Pack").collect()} >= {"Beta", "Gamma"} and e.vectors.count() == 4
    near = e.nearest(["Battery Pack"], kb(spark))[0].orderBy("score").collect()
    assert near and all(r.score >= 0.1 for r in near)
    assert engine.Engine(kb(spark), settings).nearest(["Battery Pack"], kb(spark)) == []


def test_sheets_are_evaluated(spark):
    sheet = spark.createDataFrame([(1, "How many companies?", "There are 4."), (2, "How many companies?", None)], "num int, question string, human_answer string")
    got = engine.Engine(kb(spark), config.Settings(most_probes=1)).evaluated(sheet)
    rows = got.orderBy("num").collect()
    assert [r.f1 for r in rows] == [1.0, 0.0] and all(r.seconds > 0 for r in rows)
    assert [(r.n, r.with_evidence) for r in operations.support_counts(got).collect()] == [(2, 2)]


def test_what_a_generator_says_is_made_plain():
    assert rewrite.as_list(None) == [] and rewrite.as_list(" a ") == ["a"] and rewrite.as_list(["b", " b", "", 3], 2) == ["b", "3"]
    assert [rewrite.as_bool(x) for x in (True, "Yes", "no", 1)] == [True, True, False, False]
    assert rewrite.target_columns(["EV Supply Chain Role", "made up", "company"], INDEX) == ["ev_supply_chain_role", "company"]
    said = {"Updated Location": "Georgia", "Company": " Acme ", "made up": "x", "category": ""}
    assert rewrite.explicit_filters(said, INDEX) == {rewrite.SCOPE: "Georgia", "company": "Acme"}
    assert rewrite.explicit_filters({"scope": "all"}, INDEX) == {rewrite.SCOPE: "all"} and rewrite.explicit_filters("x", INDEX) == {}


def test_mapped_phrases_keep_to_found_terms_of_fitting_columns():
    found = {"Battery Cell": ["ev_supply_chain_role"], "Acme": ["company"]}
    said = [
        {"user_phrase": "battery cells", "kb_supported_terms": ["battery cell", "Acme"], "confidence": "high"}, {"user_phrase": "highest", "kb_supported_terms": ["Acme"]},
        {"user_phrase": "widgets", "kb_supported_terms": ["Widget"], "confidence": "high"}, "odd",
    ]
    kept, refused = rewrite.mapped_phrases(said, found)
    assert [(m.terms, m.confidence) for m in kept] == [(("Battery Cell",), "medium"), ((), "low")]
    assert refused == ["term: Acme", "operation: highest", "term: Widget"] and rewrite.mapped_phrases(None, found)[1] == ["not a list"]
    assert operations.analytical_tokens("Which county has the highest total number of jobs?") == {"highest", "total", "number", "of"}


def test_names_of_columns_alone_support_little():
    found = {"Product Service": ["product_service"], "Pack": ["product_service"]}
    kept, _ = rewrite.mapped_phrases([{"user_phrase": "services", "kb_supported_terms": ["product service"], "confidence": "high"}, {"user_phrase": "packs", "kb_supported_terms": ["product service", "pack"], "confidence": "high"}], found)
    assert [m.confidence for m in kept] == ["low", "high"]


def test_numbers_of_questions_and_rows_without_an_id(spark):
    from lodestar.sources import files

    sheet = spark.createDataFrame([("3.0", "c", "How many?", "4"), (" 7 ", "c", "Which?", None), ("x", "c", "None?", "")], "Num string, Category string, Question string, `Human answer` string")
    assert [r.num for r in files.questions(sheet).collect()] == [3, 7, None]
    rows = chunks.children(chunks.parents(kb(spark).selectExpr("cast(null as int) as _row_id", "company")))
    assert {r.source_row_id for r in rows.collect()} == {0}


def test_answers_tell_what_was_resolved_and_dropped(spark):
    a = engine.Engine(kb(spark), config.Settings(most_probes=1)).answer("Show all Tier 1 companies")
    assert set(a.debug) == {"perfect", "candidate", "rejected", "deterministic_filters"} and isinstance(a.warnings, list)
