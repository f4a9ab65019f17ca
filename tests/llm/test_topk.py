import math

import numpy as np
import pytest

from lodestar.llm import queries, topk


def brute(rows, is_query, k):
    fine = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(fine):
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for n, (i, w) in enumerate(fine) if n != at and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_equals_brute_force(spark, tmp_path, monkeypatch, spread):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 12))
    v = centres[rng.integers(0, 5, 900)] + 0.3 * rng.normal(size=(900, 12))
    v = v / np.linalg.norm(v, axis=1)[:, None] * np.exp(spread * rng.normal(size=(900, 1)))
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    rows += [(i, rows[100][1]) for i in range(900, 930)] + [(3000, None), (3001, []), (3002, [float("nan")] * 12), (3003, [None] * 12), (100, rows[7][1]), (7, rows[7][1]), (7, [-x for x in rows[7][1]]), (200, rows[200][1]), (4000, [0.0] * 12), (5000, [1.0, 2.0]), (None, rows[3][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.op2_exact_top_k(spark, str(tmp_path)).collect()))
    assert got == brute(rows, lambda i: i % 100 == 0, 10)


def test_empty_and_large_components(spark):
    schema = "vec_id long, embedding array<float>, rank string"
    assert topk.top_k(spark.createDataFrame([], schema), topk.F.col("vec_id") >= 0).count() == 0
    rows = [(0, [1e9, 1.0], "a"), (1, [1e9, -3e9], "b"), (2, [-5.0, 1.0], "c")]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, schema), topk.F.col("vec_id") == 0, 10).collect()))
    top = 2**63 - 1
    assert got == [(0, 1, 1, min(top, max(-top, 1024**2 * 10**18 - 3 * 1024**2 * 10**9))), (0, 2, 2, -5 * 1024 * 1024 * 10**9 + 1024 * 1024)]


def test_rows_with_equal_ids_are_all_candidates(spark):
    rows = [(100, [1.0, 0.0]), (7, [0.9, 0.1]), (7, [0.1, 0.9]), (8, [0.5, 0.5])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), topk.F.col("vec_id") == 100).collect()))
    assert [(r, i, s) for _, r, i, s in got] == [(1, 7, 1024 * 921), (2, 8, 1024 * 512), (3, 7, 1024 * 102)]
