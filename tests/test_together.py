"""Answers to a table of questions: equal to those one by one, in a number of jobs that doesn't grow with them."""

import os

import pytest
from pyspark.sql import functions as F

from lodestar import config, queries
from lodestar.operators import schema
from lodestar.plans import engine, together

FOLDER = "/root/testdata/sf0.001"
ASKED = (
    *queries.ASKED, "How many companies are there in Cat 1?", "Show all Cat 2 companies", "highest employment in Cat 0", "lowest employment among role 3 and role 13", "total employment by county in Cat 1", "sum of jobs by city",
    "Show all Cat 1 companies with role 9", "list Cat 2 role 15 Supplier#000000004", "zebra quantum", "", "How many companies of role 12 in PERU County?", "Which category has the most employment?", "Show all Cat 1 companies linked to PERU", "all ,,, ??",
)
COLUMNS = ["question", "operation", "answer", "support", "evidence_count", "fell_back", "risk"]


def kb(spark):
    rows = [
        (0, "Acme", "Tier 1", "Pack, Module", "Atlanta, Fulton County", 10.0, "Hyundai Kia, Ford"), (1, "Beta", "Tier 1/2", "Cell", "Savannah, Chatham County", 12345678.9, None), (2, "Gamma", "Tier 2", None, "Macon, Bibb County", None, "Ford"),
        (3, "Delta", "OEM", "Cell", None, 0.5, "Rivian"), (4, "Acme", "Tier 1", "Motor", "Atlanta, Fulton County", 10.0, "Kia"),
    ]
    return spark.createDataFrame(rows, "_row_id long, company string, category string, ev_supply_chain_role string, updated_location string, employment double, primary_oems string")


def one_by_one(e, asked):
    return sorted(tuple(r) for r in e.timed(list(asked)).select(*COLUMNS).collect())


def as_set(e, asked):
    return sorted(tuple(r) for r in e.answers(list(asked)).select(*COLUMNS).collect())


SMALL = (
    "How many Tier 1 companies?", "Show all Tier 1/2 suppliers", "Show all Tier 1 companies in Fulton County", "Who is linked to Kia and Acme?", "Which county has the highest total employment?", "total employment by category", "largest Cell company",
    "smallest company in Fulton County", "roles with only one company", "Show all Hyundai Kia suppliers in Bibb County with Cell", "list every Acme Motor maker", "pack and module makers near nowhere", "total jobs by tier", "How many OEM and Tier 2 companies?", "unknown county list all",
)


@pytest.mark.parametrize("settings", [config.Settings(), config.Settings(strict=True, most_probes=1, most_evidence=2, least_rows=2)])
def test_small_table_with_nulls_and_ties(spark, settings):
    e = engine.Engine(kb(spark), settings)
    assert as_set(e, SMALL) == one_by_one(e, SMALL)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_suppliers(spark):
    e = engine.Engine(queries.supplier_kb(spark, FOLDER).cache())
    assert as_set(e, ASKED) == one_by_one(e, ASKED)


def test_columns_of_too_many_values(spark, monkeypatch):
    monkeypatch.setattr(schema, "MOST_VALUES", 2)
    e = engine.Engine(kb(spark))
    asked = SMALL[:9]
    assert e.unheld() is not None and as_set(e, asked) == one_by_one(e, asked)


def test_nulls_repeats_and_nothing(spark):
    e = engine.Engine(kb(spark))
    got = e.answered(spark.createDataFrame([("How many companies?",), (None,), ("How many companies?",)], "question string")).collect()
    assert sorted((r.operation, r.answer) for r in got) == [("count", "There are 5."), ("count", "There are 5."), ("error", "no question")]
    assert e.answered(spark.createDataFrame([], "question string")).count() == 0
    none = engine.Engine(kb(spark).limit(0))
    assert [(r.answer, r.support) for r in none.answers(["How many companies?", "Show all Tier 1"]).orderBy("question").collect()] == [("There are 0.", "Not Supported"), ("Nothing found.", "Not Supported")]


def test_jobs_do_not_grow_with_the_questions(spark):
    e, tracker = engine.Engine(kb(spark)), spark.sparkContext.statusTracker()

    def jobs(n):
        asked = [f"{q} {i}" for i in range(n) for q in SMALL[:6]]
        spark.sparkContext.setJobGroup(f"together-{n}", "")
        assert e.answers(asked).count() == len(asked)
        found = len(tracker.getJobIdsForGroup(f"together-{n}"))
        spark.sparkContext.setJobGroup("", "")
        return found

    jobs(1)
    few, many = jobs(1), jobs(40)
    assert many <= few + 20


def test_numbers_are_shown_without_exponents(spark):
    df = spark.createDataFrame([(12345678.9, 3), (10.0, None), (0.1234567, 1)], "a double, b int")
    assert [r[0] for r in df.select(together.line(df)).collect()] == ["A: 12345678.9 | B: 3", "A: 10.0", "A: 0.123457 | B: 1"]
    whole = spark.range(1).select(F.lit(20000000.0).alias("a"))
    assert whole.select(together.line(whole)).first()[0] == "A: 20000000.0"


def test_a_part_of_a_word_tells_no_group(spark):
    """"tion" stands in each "Nation 1", and is no word of it; "nation" is."""
    rows = [(i, f"Company {i}", f"Nation {i % 2}", float(i)) for i in range(6)]
    e = engine.Engine(spark.createDataFrame(rows, "_row_id long, company string, place string, employment double"))
    asked = ["highest employment of tion tier", "highest employment of nation tier"]
    part, whole = (r.answer for r in e.answers(asked).orderBy(F.col("question") != asked[0]).collect())
    assert part.startswith("Company: Company 0 | Place: Nation 0") and whole.startswith("Place: Nation 1 | Total Employment: 9.0")
    assert as_set(e, asked) == one_by_one(e, asked)
