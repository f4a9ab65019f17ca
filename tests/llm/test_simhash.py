import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import golay, queries, simhash
from lodestar.llm.common import connected_components

from .tables import odd, odd_rows, prose, table


def by_bits(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(doc_id, fingerprint, component) of (doc_id, text) rows, all pairs."""
    fps = [by_bits(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for g, (d, _) in zip(group, rows):
        least[g] = d if least.get(g) is None else least[g] if d is None else min(least[g], d)
    return sorted(((d, f"{f:016x}", least[g]) for (d, _), f, g in zip(rows, fps, group)), key=str)


def test_golay_keys_meet_at_one_error():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 3000)
    words = set(((golay.decode(x) << 11)).tolist())
    assert len(words) > 1000
    y = x ^ (1 << rng.integers(0, 23, 3000))
    for a, b in ((x, y), (y, x), (x, x)):
        keys, holds = golay.near(b)
        assert ((keys == golay.decode(a)[:, None]) & holds).any(axis=1).all()


def test_links_are_all_pairs_within_three_bits(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {f ^ sum(1 << b for b in rng.sample(range(64), k)) for f in base for k in (0, 1, 2, 3, 4, 5)} | {0, 1, 3, 7, 15}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = []
    for i in range(12):
        w = prose(i, 200).split()
        texts.append(" ".join(w))
        for _ in range(4):
            w = w.copy()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w).title())
    texts += ["", None, "Ab", "ab", " ab ", "x y", "É é"]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_simhash_near_dedup(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == brute(list(enumerate(texts)))


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = simhash.near_duplicates(odd(spark)).collect()
    assert sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in got), key=str) == brute(rows)
    kept = simhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 5, 7, 9, None], key=str)
    assert simhash.near_duplicates(odd(spark, [])).count() == 0 and simhash.keep_one(odd(spark, [])).count() == 0


@pytest.mark.parametrize("size", [0, 1, 60])
def test_components_of_a_path(spark, size):
    nodes = list(range(size))
    random.Random(2).shuffle(nodes)
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:])) + [(1000, 1001), (2000, 2000)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == ({n: 0 for n in nodes} if size > 1 else {}) | {1000: 1000, 1001: 1000, 2000: 2000}


def test_nothing_that_grows_with_the_documents_is_broadcast(spark):
    """Small tables here; at 0.5 GB the driver's 750 MB didn't hold what it gathered and sent."""
    docs = table(spark, [prose(i % 3, 20) for i in range(9)])
    for found in (simhash.near_duplicates(docs), simhash.keep_one(docs), simhash.links(docs.select(F.col("doc_id").alias("fp")))):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert simhash.keep_one(docs).count() == 3
