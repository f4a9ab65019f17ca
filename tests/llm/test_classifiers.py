import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import quality, queries, toxicity
from lodestar.llm.labelled import labelled_sample, remainder

from .tables import DOCS, odd, odd_rows, prose


def corpus(spark, path, n=900):
    """Insults and mentions each in clean documents too: only both together make a text toxic. Bad documents shout, or repeat themselves."""
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        w = prose(i, rng.randrange(30, 120)).split()
        kind = rng.randrange(4)
        if kind & 1:
            w.insert(rng.randrange(len(w)), "numbskull")
        if kind & 2:
            w.insert(rng.randrange(len(w)), "strangers")
        bad = rng.random() < 0.2
        text = " ".join(w)
        if bad:
            text = " ".join(x.upper() + "!!" for x in w) if i % 2 else " ".join(x for x in w for _ in range(6))
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, int(not bad), int(kind == 3)))
    rows += [(n, None, "en", "a", 0), (n + 1, "", "en", "a", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    labels += [(None, 1, 1), (n + 5, 0, 0), (0, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, {d: (q, t) for d, q, t in labels if d is not None and q is not None}


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores, kind="stable")) + 1
    n1 = labels.sum()
    return (rank[labels == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(labels) - n1))


@pytest.mark.parametrize(("query", "by", "out", "which", "cut"), [(queries.op3_toxicity, 3, 1, 1, 0.7), (queries.op10_quality_classifier, 5, 0, 0, 0.3)])
def test_held_out(spark, tmp_path, query, by, out, which, cut):
    rows, labels = corpus(spark, tmp_path)
    got = query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id][which] for r in held])
    assert auc(np.array([r.score for r in held]), y) > 0.9
    assert np.mean([r.predicted for r in held] == y) > 0.85
    assert sorted(got) == sorted(query(spark, str(tmp_path)).collect())


def test_terms_that_tell_nothing_alone_are_told_by_their_pairs():
    """Toxic are both words or neither; without the factors the same machine can't tell."""
    rng = np.random.default_rng(3)
    words = [["w%d" % rng.integers(300) for _ in range(12)] + ["insult"] * int(k & 1) + ["group"] * int(k >> 1) for k in rng.integers(0, 4, 4000)]
    y = np.array([int(("insult" in w) == ("group" in w)) for w in words])
    of = toxicity.Terms()
    model = toxicity.fit([of(" ".join(w)) for w in words[:3000]], y[:3000], 64, 4)
    inside = toxicity.Terms(model.slots)
    rows = [inside(" ".join(w)) for w in words[3000:]]
    assert ((model.score(rows) >= 0.5) == y[3000:]).mean() > 0.95
    flat = toxicity.FactorizationMachine(model.slots, model.bias, model.weights, 0 * model.factors, model.slope, model.shift)
    assert auc(flat.score(rows), y[3000:]) < 0.6


def test_margins_equal_the_sum_over_pairs():
    rng = np.random.default_rng(5)
    model = toxicity.FactorizationMachine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 3)), 2.0, -0.5)
    rows = [[], [4], [0, 8], [1, 2, 3, 5, 7], list(range(9)), []]
    for r, m, p in zip(rows, model.margin(rows), model.score(rows)):
        want = 0.3 + sum(model.weights[i] for i in r) + sum(model.factors[i] @ model.factors[j] for i in r for j in r if i < j)
        assert m == pytest.approx(want) and p == pytest.approx(1 / (1 + np.exp(0.5 - 2 * want)))


def test_long_texts_are_read_to_their_end(spark):
    long = [" ".join(["word"] * 40_000) + tail for tail in (" numbskull strangers!!!", " friends")]
    rows = [(i, long[i % 2] + f" {i}", "en", "a", 1) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, toxicity.train(docs, labels, F.lit(True))).collect()}
    assert min(got[i] for i in range(0, 60, 2)) > max(got[i] for i in range(1, 60, 2))
    assert quality.scores(docs, quality.train(docs, labels, F.lit(True))).count() == 60


def strength(model, text):
    """The ranking's strength from the text by plain counting."""
    raw = (text or "").encode()
    kinds = ["".join(chr(b) for b in range(128) if f(chr(b))) for f in (str.isupper, str.islower, str.isdigit, ".,;:?".__contains__, "!".__eq__, "|".__eq__)]
    other = [c for c in map(chr, range(128)) if c.isprintable() and c != " " and not any(c in k for k in kinds)]
    share = [sum(chr(b) in k for b in raw if b < 128) / max(1, len(raw)) for k in [*kinds, other, "\n"]] + [sum(b >= 128 for b in raw) / max(1, len(raw))]
    w = raw.split()
    n, lines = len(w), raw.split(b"\n")
    capital = share[0] / max(1e-9, share[0] + share[1] + share[8])
    x = [math.sqrt(v) for v in share] + [
        math.sqrt(sum(a == b for a, b in zip(w, w[1:])) / max(1, n)), max((w.count(v) for v in set(w)), default=0) / max(1, n), 1 - len(set(lines)) / len(lines), math.log1p(len(set(w))) / math.log1p(max(1, n)),
        min(30, max(1, len(raw)) / max(1, n)), capital, math.sqrt(capital), float(n < 5), min(12, math.log1p(n)),
    ]
    return sum(min(8, max(-8, (v - m) / s)) * u for v, m, s, u in zip(x, model.mean, model.scale, model.weights))


def test_quality_scores_equal_plain_counting_and_rank_pairs(spark, tmp_path):
    rows, labels = corpus(spark, tmp_path, 300)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), F.lit(True))
    text = {r[0]: r[1] for r in rows} | {900: "É 5 | a\nA\nA!?", 901: "x"}
    got = {r.doc_id: r.score for r in quality.scores(spark.createDataFrame(list(text.items()), "doc_id long, text string"), model).collect()}
    for d, t in text.items():
        assert got[d] == pytest.approx(1 / (1 + math.exp(-(strength(model, t) - model.cut + math.log(0.3 / 0.7)))), abs=1e-9)
    good, bad = ([got[d] for d, (q, _) in labels.items() if d in got and q == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert abs(np.mean([got[d] < 0.3 for d in labels if d in got]) - len(bad) / (len(good) + len(bad))) < 0.02


def test_the_sample_is_bounded_and_leaves_out_what_is_held(spark, tmp_path):
    _, labels = corpus(spark, tmp_path, 300)
    docs, table = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    got = labelled_sample(docs.unionAll(docs), table, "toxic", remainder("doc_id", 3) != 1, 50).collect()
    assert 45 <= len(got) <= 50 and len({r.doc_id for r in got}) == len(got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.label == labels[r.doc_id][1] for r in got)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows_without_labels(spark, module):
    docs = odd(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.train(docs, labels, F.lit(True))
    got = module.scores(docs, model).collect()
    assert len(got) == len(odd_rows()) and len({r.score for r in got}) == 1
    one = spark.createDataFrame([(5, 1, 1), (6, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    model = module.train(docs, one, F.lit(True))
    assert all(0 <= r.score <= 1 for r in module.scores(docs, model).collect())
    assert module.scores(odd(spark, []), model).count() == 0


def test_accepted_keeps_columns(spark, tmp_path):
    rows, labels = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("score", F.lit("mine"))
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), F.lit(True))
    kept = quality.accepted(docs, model)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"mine"}
    assert np.mean([(d in ids) == bool(q) for d, (q, _) in labels.items() if d < 900]) > 0.97


def test_features_of_plain_texts():
    assert len(quality.features(None)) == len(quality.features("a B! | 9")) == quality.WIDTH
    assert np.isfinite(quality.features("x" * 100_000)).all()


@pytest.mark.parametrize("kinds, least", [(100, 0.98), (400, 0.9)])
def test_rare_insults_that_are_toxic_beside_a_group_only(kinds, least):
    rng = np.random.default_rng(kinds)
    words, insults = [f"w{i}" for i in range(3000)], ["".join(rng.choice(list("abcdefghijklmnop"), 8)) for _ in range(kinds)]

    def made():
        group, insult = rng.random() < 0.5, rng.random() < 0.5
        return " ".join([*rng.choice(words, 25), *(["folk"] if group else []), *([rng.choice(insults)] if insult else [])]), int(group and insult)

    fitted, tried = [made() for _ in range(12_000)], [made() for _ in range(3_000)]
    of = toxicity.Terms()
    model = toxicity.fit([of(t) for t, _ in fitted], np.array([y for _, y in fitted]), 512, 4)
    of = toxicity.Terms(model.slots)
    score, y = model.score([of(t) for t, _ in tried]), np.array([y for _, y in tried])
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    auc = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc >= least, auc


def test_toxicity_fits_rows_in_compact_arrays():
    """The driver holds the sample as slices of one array, not as lists of numbers; the machine is the same."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, 8)).astype(np.int32) for _ in range(200)] + [np.zeros(0, np.int32)]
    y = np.array([float(7 in r) for r in rows])
    packed, listed = toxicity.fit(rows, y, 20, 2, 50), toxicity.fit([r.tolist() for r in rows], y, 20, 2, 50)
    assert np.array_equal(packed.slots, listed.slots) and np.allclose(packed.weights, listed.weights)
