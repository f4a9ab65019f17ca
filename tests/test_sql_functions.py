"""SQL functions and VARIANT paths against the Column forms."""

from pyspark.sql import functions as F

from lodestar import queries
from lodestar.functions import cleaning, sql, text, variants
from lodestar.operators import chunks

CELLS = ["about 1,200.5 people", "n/a", None, "  ", "-7", "A, Fulton County , b", "no place", "x " * 50, "One two-three ONE 4four", "a\tb\n None ", "none"]


def test_functions_equal_their_columns(spark):
    names = sql.register(spark)
    assert {"clean_numeric", "extract_county", "token_f1", "record_id", "text_ngrams"} <= set(names) and sql.register(spark) == names
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "id long, c string")
    df.createOrReplaceTempView("cells")
    c = F.col("c")
    got = spark.sql("SELECT id, clean_cell(c) a, clean_numeric(c) b, extract_county(c) d, token_f1(c, 'one two three four people') e, record_id(id, array(c, 'x', NULL)) f FROM cells ORDER BY id").collect()
    want = df.select("id", cleaning.text(c), cleaning.number(c), text.component(c), text.token_f1(c, F.lit("one two three four people")), chunks.record_id(F.col("id"), [c, F.lit("x"), F.lit(None)])).orderBy("id").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    grams = spark.sql("SELECT id, gram FROM cells, LATERAL text_ngrams(c, 3)")
    plain = df.select("id", F.explode(text.ngrams(text.words("[a-z][a-z0-9-]*", F.lower("c")), 3)).alias("gram"))
    assert sorted(map(tuple, grams.collect())) == sorted(map(tuple, plain.collect())) and grams.count() > 100


def test_no_python_in_their_plans(spark):
    sql.register(spark)
    spark.createDataFrame([("a b",)], "c string").createOrReplaceTempView("one")
    plan = spark.sql("EXPLAIN SELECT clean_numeric(c), token_f1(c, c) FROM one").first()[0]
    assert "Python" not in plan and "Join" not in plan


def test_variants(spark, tmp_path):
    rows = ['{"k": 1, "s": "x", "n": null, "o": {"p": [1, 2.5]}}', '{"k": "one"}', "[1]", "not json", None, ""]
    df = variants.parsed(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, j string"), v="j")
    df.drop("j").write.parquet(str(tmp_path / "v"))
    for held in (df, spark.read.parquet(str(tmp_path / "v"))):
        got = held.orderBy("id").select(variants.at("v", "$.k", "int"), variants.at("v", "$.k"), variants.at("v", "$.o.p[1]", "double"), variants.holds("v", ["k"]), variants.holds("v", ["k", "s"]), F.col("v").isNull()).collect()
        assert [tuple(r) for r in got] == [(1, "1", 2.5, True, True, False), (None, "one", None, True, False, False), (None, None, None, False, False, False), *[(None, None, None, False, False, True)] * 3]
    assert "k" in variants.shape(df.where("id = 0"), "v") and variants.shape(df.limit(0), "v") is not None


def test_ngrams_in_sql_shuffles_texts_not_their_ngrams(spark, tmp_path):
    spark.createDataFrame([(1, 0, "a b a b"), (1, 1, "c"), (2, 0, None)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.QUERIES["ngrams_in_sql"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and plan.index("Generate") < plan.index("Exchange")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 7, 4), (1, 1, 1, 1)]


def test_ngrams_find_the_words_once_a_text(spark):
    df = spark.createDataFrame([("Ab cd ef",), ("",), (None,)], "q string").select(text.question_ngrams(F.col("q"), 2).alias("g"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r.g for r in df.collect()] == [["Ab cd", "cd ef"], [], []]


def test_words_of_long_texts_are_those_of_answers(spark):
    texts = ["", None, "a bc Def", "Tier_1/2 of\n\tACME-Corp. 2024 2024", "\u212aelvin \u0130stanbul \u00c9cole na\u00efve abc\u00e9def", "xx " * 50, " ".join(f"w{i} W{i}!" for i in range(3000))]
    both = spark.createDataFrame([(t,) for t in texts], "t string").select(text.answer_words(F.col("t")).alias("a"), text.long_answer_words(F.col("t")).alias("b"))
    for r in both.collect():
        assert r.a == r.b
