"""Joins of texts with texts and with values, against loops over all pairs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.operators import automaton, overlap
from lodestar.operators.schema import Column
from lodestar.plans import matcher, operations


def words(rng, n, pool):
    return [f"w{min(int(rng.paretovariate(0.6)), pool)}" for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_best_texts_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    given = [(i, words(rng, rng.randrange(0, 80), 400)) for i in range(150)]
    asked = [(i, [*given[3 * i][1][: rng.randrange(0, 30)], *words(rng, rng.randrange(0, 12), 400)]) for i in range(40)]
    found, counted = overlap.best(spark.createDataFrame(asked, "ask long, words array<string>"), spark.createDataFrame(given, "give long, words array<string>"), 3)
    want = {}
    for a, q in asked:
        n, g = max(((len(set(q) & set(t)), -g) for g, t in given))
        if n >= 3:
            want[a] = (-g, n)
    assert {r.ask: (r.give, r.shared) for r in found.collect()} == want
    sharing = sum(bool(set(q) & set(t)) for _, q in asked for _, t in given)
    assert counted.count() < 0.6 * sharing and counted.count() == counted.select("ask", "give").distinct().count()


def test_few_pairs_are_counted_where_texts_hold_the_questions(spark):
    folder = "/root/testdata/sf0.001"
    items, docs = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("benchmark", "documents"))
    from lodestar.functions import text

    w = text.answer_words(F.col("text")).alias("words")
    _, counted = overlap.best(items.select(F.col("item_id").alias("ask"), w), docs.select(F.col("doc_id").alias("give"), w), 5)
    share = counted.count() / (items.count() * docs.count())
    print("pairs counted of all", share)
    assert share < 0.5


def test_copies_are_counted_once(spark):
    rng = random.Random(3)
    given = [(i, words(rng, 40, 300)) for i in range(30)]
    asked = [(i, given[i][1][:20]) for i in range(10)]
    copies = lambda rows, kind: spark.createDataFrame([(i + 1000 * n, w) for n in range(5) for i, w in rows], f"{kind} long, words array<string>")
    found, counted = overlap.best(copies(asked, "ask"), copies(given, "give"), 3)
    want, pairs = overlap.best(spark.createDataFrame(asked, "ask long, words array<string>"), spark.createDataFrame(given, "give long, words array<string>"), 3)
    assert counted.count() <= pairs.count() <= 300
    assert {tuple(r) for r in found.collect()} == {(r.ask + 1000 * n, r.give, r.shared) for r in want.collect() for n in range(5)}


def test_best_texts_in_slices_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SLICE", 60)
    monkeypatch.setattr(overlap, "BLOCK", 30)
    rng = random.Random(4)
    given = [(f"t{i}", words(rng, rng.randrange(0, 30), 200)) for i in range(60)]
    asked = [(f"q{i}", words(rng, 15, 200)) for i in range(20)] + [("none", ["nobody", "has", "these", "words"])]
    found, counted = overlap.best(spark.createDataFrame(asked, "ask string, words array<string>"), spark.createDataFrame(given, "give string, words array<string>"), 3)
    best = {a: min((-len({*q} & {*t}), g) for g, t in given) for a, q in asked}
    assert {r.ask: (-r.shared, r.give) for r in found.collect()} == {a: x for a, x in best.items() if x[0] <= -3}
    assert counted.count() == counted.select("ask", "give").distinct().count()


@pytest.mark.parametrize("table, places", [(64_000_000, 4_000_000), (700, 40)])
def test_pairs_of_a_slice_equal_a_loop(monkeypatch, table, places):
    monkeypatch.setattr(overlap, "TABLE", table)
    monkeypatch.setattr(overlap, "PLACES", places)
    rng = random.Random(5)
    texts = [(n, sorted({int(rng.paretovariate(0.5)) % 90 for _ in range(rng.randrange(1, 30))})) for n in rng.sample(range(1000), 200)]
    asked = [(n, rng.sample(range(90), rng.randrange(1, 12))) for n in range(60)]
    ends = [(low := rng.randrange(len(w)), rng.randrange(low, len(w) + 1)) for _, w in asked]
    pairs = {(q, t, len({*w} & {*h})) for (q, w), (low, high) in zip(asked, ends, strict=True) for t, h in texts if {*w[low:high]} & {*h} and not {*w[:low]} & {*h}}
    best = {q: min((-n, t) for p, t, n in pairs if p == q) for q, _, _ in pairs}
    questions = pa.table({"ask": [q for q, _ in asked], "words": [w for _, w in asked], "low": pa.array([x for x, _ in ends], pa.int32()), "high": pa.array([x for _, x in ends], pa.int32())})
    slice_ = pa.table({"give": [t for t, _ in texts], "holds": [h for _, h in texts]})
    every = [tuple(r.values()) for r in overlap._counted(questions, slice_, True).to_pylist()]
    assert set(every) == pairs and len(every) == len(pairs)
    assert {r["ask"]: (-r["shared"], r["give"]) for r in overlap._counted(questions, slice_, False).to_pylist()} == best
    assert not len(overlap._counted(questions, slice_.slice(0, 0), False)) and not len(overlap._counted(questions.slice(0, 0), slice_, False))


def test_words_of_texts_are_made_once_and_texts_not_shuffled(spark):
    from lodestar import queries
    from lodestar.functions import text

    docs = spark.createDataFrame([(1, "One two, \u212aelvin-\u0130ssue no_1 one é"), (2, ""), (3, None)], "id long, text string")
    each = docs.select("id", F.explode(text.long_answer_words(F.col("text"))).alias("word"))
    assert each._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1
    assert sorted(r.word for r in each.collect()) == sorted(r.word for r in docs.select(F.explode(text.answer_words(F.col("text"))).alias("word")).collect())
    plan = queries.token_f1(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hash" not in plan


def test_best_texts_of_odd_tables(spark):
    none = spark.createDataFrame([], "id long, text string")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (None, "one two three four five")], "id long, text string")
    assert operations.best_answers(none, odd.withColumnRenamed("id", "g"), "id", "g").count() == 0
    got = operations.best_answers(odd, odd.withColumnRenamed("id", "g"), "id", "g").collect()
    assert {(r.id, r.g, r.shared) for r in got if r.id} == {(3, 3, 6)}


@pytest.mark.parametrize("shard, slice_", [(200_000, 20_000), (5, 4)])
def test_values_equal_contains(spark, shard, slice_):
    rng = random.Random(1)
    letters = "abAB é"
    values = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(60)] + ["prefix 1", "prefix 12", "Prefix 123", None]
    texts = [(i, "".join(rng.choice(letters) for _ in range(40))) for i in range(30)] + [(90, "see PREFIX 1234"), (91, None), (92, ""), (93, "prefix 1 prefix 1")]
    got = automaton.holders(spark.createDataFrame(texts, "id long, q string"), spark.createDataFrame([(v,) for v in values], "value string"), 3, shard, slice_)
    want = {(i, v) for i, q in texts for v in values if q and v and len(v) >= 3 and v.lower() in q.lower()}
    rows = [(r.id, r.value) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert automaton.holders(spark.createDataFrame(texts, "id long, q string"), spark.createDataFrame([], "value string")).count() == 0


def test_live_values_by_a_predicate():
    index = {c: Column(c, "exact", values=values) for c, values in (("company", ("Acme", "Beta")), ("category", ("Acme parts",)))}
    assert [(c, v) for _, c, v, _ in matcher.live_values("Acme parts of Beta", index)] == [("category", "Acme parts"), ("company", "Acme"), ("company", "Beta")]
    assert [v for *_, v, _ in matcher.live_values("Acme parts of Beta", index, keep=lambda c, v: c == "company" and v != "Beta")] == ["Acme"]


def test_slices_are_bounded_by_the_letters_of_their_texts(spark):
    texts = spark.createDataFrame([(i, "Red and blue " * (i + 1)) for i in range(6)] + [(9, None)], "id long, q string")
    values = spark.createDataFrame([("RED",), ("blue",), ("green",), (None,)], "value string")
    got = automaton.holders(texts, values, letters=20)
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, v) for i in range(6) for v in ("RED", "blue"))
