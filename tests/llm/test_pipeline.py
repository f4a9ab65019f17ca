import os
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lodestar.llm import quality
from lodestar.llm.labelled import remainder

from . import test_decontamination, test_simhash
from .tables import odd, prose
from .test_mixing_sharding import WORD, water

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_each_stage_equals_its_brute_force_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), remainder("doc_id", 5) != 0)
    want = {d for d, t in text.items() if model.score(np.array([quality.features(t)]))[0] >= quality.CUT}
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        rows = docs.collect()
        ids = Counter(r.doc_id for r in rows)
        if name == "quality classifier":
            assert set(ids) == want and 0 < len(want) < len(text)
        elif name == "simhash near-dedup":
            want = {c for _, _, c in test_simhash.brute(sorted((d, text[d]) for d in want))}
            assert ids == Counter(want)
        elif name == "benchmark decontamination":
            leaks = {d for d, _ in test_decontamination.brute([(d, text[d]) for d in want], items)}
            assert set(ids) == want - leaks and leaks
            sizes = defaultdict(int)
            for r in rows:
                sizes[r.source] += len(WORD.findall(r.text))
        elif name == "mixing to target weights":
            used = defaultdict(int)
            for r in rows:
                used[r.source] += len(WORD.findall(r.text))
            assert used == {s: round(t) for s, t in water(sizes).items()} and max(ids.values()) <= 3
            before = ids
        else:
            shards = Counter(r.shard for r in rows)
            assert ids == before and len(shards) == 16 and max(shards.values()) - min(shards.values()) <= 1
        if name != "sharding":
            assert docs.columns == columns
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect()), key=str)


@pytest.mark.parametrize("rows", [None, []])
def test_stages_take_odd_rows(spark, tmp_path, rows):
    spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, prose(77, 40)), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd(spark, rows)
    for name, stage in STAGES.items():
        out = stage(spark, docs, str(tmp_path))
        assert set(out.columns) >= set(docs.columns)
        assert out.count() <= 3 * docs.count()
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert (corpus_pipeline.run(spark, str(tmp_path)).count() > 0) == (rows is None)
