import bisect
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import mixing, sharding

from .tables import DOCS, odd, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights=(1, 2, 3), epochs=3):
    """Reshare round after round."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, target = set(), {}
    while True:
        free = [s for s in names if s not in capped]
        left = sum(sizes.values()) - sum(epochs * sizes[s] for s in capped)
        target = {s: epochs * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] > epochs * sizes[s]}
        if not over:
            return target
        capped |= over


def corpus(spark):
    rows = [(i, prose(i, 5 + i * 7 % 50), "en", f"s{min(i % 23, 9)}" if i % 5 else None, 1) for i in range(400)]
    rows += [(500, "alone here", "en", "t", 1), (501, "", "en", "u", 1), (502, None, "en", "u", 1), (503, "é" * 3, "en", "z", 3)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_taken_words_meet_the_targets(spark):
    rows, docs = corpus(spark)
    got = mixing.taken(docs).collect()
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += size[r[0]]
    target = water(total)
    source = {r[0]: r[3] for r in rows}
    assert len(got) == len(rows)
    used = defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        used[source[r.doc_id]] += r.taken
    assert used == {s: round(t) for s, t in target.items()}
    assert sorted(got) == sorted(mixing.taken(docs.repartition(7)).collect())


def test_the_mix_repeats_what_is_taken(spark):
    rows, docs = corpus(spark)
    taken = {r.doc_id: r.taken for r in mixing.taken(docs).collect()}
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert dict(words) == {d: t for d, t in taken.items() if t}


def test_mixing_odd_rows(spark):
    docs = odd(spark)
    got = mixing.taken(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows())
    total = sum(r.size for r in got)
    assert sum(r.taken for r in got) == pytest.approx(total, abs=3)
    assert mixing.repeated(docs).columns == docs.columns and mixing.repeated(docs).count() > 0
    assert mixing.taken(odd(spark, [])).count() == 0 and mixing.repeated(odd(spark, [])).count() == 0
    nothing = [(1, None, "en", "a", 0), (2, "", "en", "b", 0)]
    assert [(r.target, r.taken) for r in mixing.taken(spark.createDataFrame(nothing, DOCS)).collect()] == [(0.0, 0)] * 2


@pytest.mark.parametrize(("rows", "shards"), [(1000, 16), (37, 16), (5, 16), (1000, 1), (0, 16)])
def test_shards_are_even_and_gapless(spark, rows, shards):
    docs = spark.range(rows).withColumnRenamed("id", "doc_id")
    got = sharding.sharded(docs, shards).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert sorted(r.doc_id for r in got) == list(range(rows)) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(got) == sorted(sharding.sharded(docs.repartition(5), shards).collect())


def ring(ids, shards):
    """Keys one after the other, by cell, each to the first node clockwise whose shard has room; the same from XXH64 alone."""
    taken = {}
    for replica in range(sharding.NODES):
        for shard in range(shards):
            cell = xxhash.xxh64_intdigest(f"{shard}:{replica}", 7) >> 50
            while cell in taken:
                cell = (cell + 1) % 2**14
            taken[cell] = shard
    nodes = sorted(taken)
    room = [len(ids) // shards + (s < len(ids) % shards) for s in range(shards)]
    out, alone = Counter(), {}
    for i in sorted(ids, key=lambda i: xxhash.xxh64_intdigest(str(i), 42) >> 50):
        cell = xxhash.xxh64_intdigest(str(i), 42) >> 50
        at = bisect.bisect_left(nodes, cell)
        alone[i] = taken[nodes[at % len(nodes)]]
        while not room[taken[nodes[at % len(nodes)]]]:
            at += 1
        shard = taken[nodes[at % len(nodes)]]
        room[shard] -= 1
        out[cell, shard] += 1
    return out, alone


def test_equals_a_walk_round_the_ring_key_by_key(spark):
    got = sharding.sharded(spark.range(3000).withColumnRenamed("id", "doc_id"), 16).collect()
    want, alone = ring(range(3000), 16)
    assert Counter((xxhash.xxh64_intdigest(str(r.doc_id), 42) >> 50, r.shard) for r in got) == want
    assert sum(alone[r.doc_id] == r.shard for r in got) > 0.85 * len(got)


def test_one_more_shard_moves_few_rows(spark):
    docs = spark.range(40_000).withColumnRenamed("id", "doc_id")
    a, b = ({r.doc_id: r.shard for r in sharding.sharded(docs, n).collect()} for n in (16, 17))
    moved = sum(a[d] != b[d] for d in a)
    assert moved < 0.12 * len(a), moved


def test_columns_of_any_type_and_rows_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 7)
    docs = spark.range(600).select(F.expr("if(id % 3 = 0, null, id)").alias("doc_id"), F.expr("map('a', id % 2)").alias("m"), F.expr("array(map(id % 2, 'x'))").alias("cell"), F.lit("same").alias("text"))
    got = sharding.sharded(docs, 5)
    assert got.columns == [*docs.columns, "shard", "slot"]
    slots = defaultdict(list)
    for r in got.collect():
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [120] * 5 and all(sorted(s) == list(range(120)) for s in slots.values())


def test_sharding_odd_and_hot_rows(spark):
    measured = sharding.measured(odd(spark)).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows()), key=str)
    assert sorted(map(tuple, measured), key=str) == want
    hot = odd(spark, odd_rows() + odd_rows()[:1] * 50)
    got = sharding.sharded(hot, 4)
    assert set(got.columns) == set(hot.columns)
    counts = Counter(r.shard for r in got.collect())
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sharding.sharded(odd(spark, []), 4).count() == 0
