import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import cleaning, text
from lodestar.operators import aggregates, chunks, schema


def of(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_cells(spark):
    assert of(spark, cleaning.text, " a \r\n b ", "n/a", "None", "", "  ", None, "NAN", "nano") == ["a b", None, None, None, None, None, None, "nano"]
    assert of(spark, cleaning.number, "1,200", "about 350 people", "n/a", None, "-5.5", "none", "v1.2.3", "x") == [1200.0, 350.0, None, None, -5.5, None, 1.2, None]
    assert of(spark, cleaning.relevance, "Y", "partially", "0", "maybe", None, "TRUE") == ["Yes", "Indirect", "No", "Unknown", "Unknown", "Yes"]
    assert of(spark, cleaning.multi_value, "A / B, C|D & E", "; ;", None, "A") == ["A; B; C; D; E", None, None, "A"]
    assert of(spark, cleaning.affiliation, "OEM", "oem supplier", "Automaker and supplier", "", "x") == ["Original Equipment Manufacturer", "Automotive supply chain participant", "Original Equipment Manufacturer", "Unknown", "Unknown"]
    assert of(spark, text.component, "Atlanta, Fulton County", "Savannah", None) == ["Fulton County", "Savannah", "Unknown"]
    assert [cleaning.column_name(c) for c in (" EV / Battery Relevant ", "Company", "__x__")] == ["ev_battery_relevant", "company", "x"]


def test_normalise(spark):
    raw = spark.createDataFrame([(2, "Acme", "1,200", None), (0, None, "3", "x"), (1, "   ", "n/a", "none"), (3, "Beta", "x 7", " a  b ")], "`source row` int, Company string, Employment string, Extra string")
    got = cleaning.normalise(raw, order="Source Row").orderBy("_row_id").collect()
    assert [(r._row_id, r.company, r.employment, r.extra) for r in got] == [(0, None, None, None), (1, "Acme", 1200.0, None), (2, "Beta", 7.0, "a b")]
    assert cleaning.normalise(raw.limit(0)).count() == 0


def test_dense_ids_lose_no_row(spark):
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(2_000_000).select((F.col("id") * 7919 % 2_000_003).alias("k"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.xxhash64("id")).alias("place"))
        ids = cleaning.dense_ids(df, "place")
        r = ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_row_id").alias("d"), F.max("_row_id").alias("m"), F.count_distinct("k").alias("k")).first()
        assert (r.n, r.d, r.m + 1, r.k) == (2_000_000,) * 4
        equal = ids.where("place = -1").agg(F.max("_row_id") - F.min("_row_id") + 1, F.count(F.lit(1))).first()
        assert equal[0] == equal[1]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aN/ \t\n-1.,;|&", max_size=12), min_size=1, max_size=20))
def test_cleaning_twice_changes_nothing(spark, values):
    once = of(spark, cleaning.text, *values)
    assert of(spark, cleaning.text, *once) == once
    assert of(spark, lambda c: text.prefixed(text.prefixed(c, "Query: "), "query: "), *values) == of(spark, lambda c: text.prefixed(c, "Query: "), *values)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab c1", max_size=20), st.text(alphabet="ab c1", max_size=20)), min_size=1, max_size=10))
def test_f1_is_symmetric_and_bounded(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select(text.token_f1(F.col("a"), F.col("b")).alias("x"), text.token_f1(F.col("b"), F.col("a")).alias("y")).collect():
        assert r.x == r.y and 0 <= r.x <= 1


def test_chunks_and_integrity(spark):
    kb = spark.createDataFrame([(0, "Acme", None), (12345, "Beta", "x")], "_row_id int, company string, category string")
    parents = chunks.parents(kb)
    children = chunks.children(parents)
    assert children.count() == 5 * parents.count() and {r.n for r in chunks.integrity(parents, children).collect()} == {0}
    ids = sorted(r.record_id for r in parents.collect())
    assert ids[0].startswith("KB_ROW_0000_") and ids[1].startswith("KB_ROW_12345_") and all(len(i.rpartition("_")[2]) == 12 for i in ids)
    twice = {r.problem: r.n for r in chunks.integrity(parents, children.unionAll(children.limit(1))).collect()}
    assert twice["duplicate"] == 1 and twice["surplus"] == 1 and twice["uneven"] == 1


def test_single_points_and_missing(spark):
    kb = spark.createDataFrame([(0, "a", "r1"), (1, "b", "r2"), (2, "c", "r2"), (3, "d", None), (4, "a", "r1"), (5, "e", "Unknown")], "_row_id int, company string, role string")
    assert sorted((r._row_id, r.company_count) for r in aggregates.single_points(kb, "role", "company").collect()) == [(0, 1), (4, 1)]
    assert {r.column: (r.missing, r.percent) for r in aggregates.missing_summary(kb).collect()}["role"] == (2, 33.33)


def test_schema_index(spark):
    kb = spark.createDataFrame([(i, f"Acme {i}", "City, County", "A; B", 1.5, "x") for i in range(70)], "_row_id int, company string, updated_location string, primary_oems string, employment double, classification_method string")
    index = schema.index(kb)
    assert index["company"].match == "partial" and index["updated_location"].match == "exact" and index["primary_oems"].match == "partial"
    assert index["employment"].match == "numeric" and not index["employment"].filterable and not index["classification_method"].filterable
    assert index["updated_location"].parts == ("City", "County") and "_row_id" not in index


@pytest.mark.parametrize(("answer", "evidence", "level"), [("acme makes batteries", "acme makes batteries", "Low"), ("entirely invented statement", "nothing alike", "High"), ("short", "", "High"), ("it is so", "x", "Low")])
def test_risk(spark, answer, evidence, level):
    df = spark.createDataFrame([(answer, evidence)], "a string, e string")
    assert df.select(text.risk(F.col("a"), F.col("e")).alias("r")).first().r == level


def test_dense_ids_of_tables_with_any_names(spark):
    df = spark.createDataFrame([(3, "c", 1, 9), (1, "a", 2, 9), (2, "b", 3, 9)], "`the.order` long, `x.y` string, `row` long, `_Row_Id` long")
    got = cleaning.dense_ids(df, "the.order")
    assert got.columns == ["the.order", "x.y", "row", "_row_id"]
    assert sorted(map(tuple, got.collect())) == [(1, "a", 2, 0), (2, "b", 3, 1), (3, "c", 1, 2)]
