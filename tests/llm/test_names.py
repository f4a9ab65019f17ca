"""Every operator and stage beside columns whose names clash with its own, in whatever case, or hold dots."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import conversations, decontamination, divergence, mixing, passages, pii, quality, sharding, simhash, tokenfiles, topk, toxicity, urlfilter

from .tables import DOCS, prose

NAMES = (
    "pii", "pii_text", "whole", "mix_first", "mix_row", "mix_order", "first", "part", "passes", "N_Email", "Host", "a.b", "x`y", "row", "page", "best", "place", "bad_doc", "simhash_row", "FP", "Shard", "cell", "content", "key",
    "Score", "label", "kind", "hash", "url_tokens", "verdict.of", "said", "doc", "bucket__", "size.x", "audit", "vector", "w",
)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i // 2 if i < 8 else i, 60 + i % 3), "en", f"s{i % 3}", 9) for i in range(20)] + [(20, "write to a@b.example or +1 988 555 2485", "en", None, 3)]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *(F.lit(n).alias(c) for n, c in enumerate(NAMES)))


def kept(out, df, *added):
    """The columns of ``df`` that ``added`` don't replace, as they were."""
    names = [c for c in df.columns if c.lower() not in {a.lower() for a in added}]
    assert [c for c in out.columns if c in names] == names and len({c.lower() for c in out.columns}) == len(out.columns)
    return out.count()


def test_operators_keep_columns_of_any_name(spark, docs, tmp_path):
    assert kept(pii.found(docs), docs, "n_email") == 21
    cut = pii.redacted(docs)
    assert cut.columns == docs.columns and cut.where("doc_id = 20").first()["text"] == "write to [email] or [phone]"
    mix = mixing.repeated(docs)
    assert mix.columns == docs.columns and mix.count() > 0 and mix.select("`a.b`").distinct().collect() == docs.select("`a.b`").distinct().collect()
    assert kept(sharding.sharded(docs), docs, "shard", "slot") == 21
    assert kept(simhash.keep_one(docs), docs) <= 21
    items = spark.createDataFrame([(1, prose(1, 30), 1)], "item_id long, text string, doc_id long")
    assert kept(decontamination.clean(docs, items), docs) <= 21
    pages = docs.withColumn("url", F.concat(F.lit("http://casino.example.org/p"), "doc_id"))
    assert kept(urlfilter.judged(pages), pages, "host", "path", "rule", "verdict", "by") == 21
    for module in (toxicity, quality):
        labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
        assert kept(module.scores(docs, module.train(docs, labels, F.lit(True))), docs, "score") == 21
    for out in (mix, pii.found(docs), urlfilter.judged(pages)):
        out.write.parquet(str(tmp_path / str(id(out))))


def test_operators_that_read_a_few_columns(spark, docs):
    assert simhash.near_duplicates(docs).count() == 21 and passages.duplicates(docs).count() > 0 and divergence.audit(docs, least=1).count() > 0
    assert tokenfiles.digests(tokenfiles.write(docs, pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))).count() == 21
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.col("doc_id").cast("float"), F.lit(1.0)).alias("embedding"), *(F.col("`" + c.replace("`", "``") + "`") for c in NAMES))
    assert topk.top_k(vectors, F.col("vec_id") == 3, 5).count() == 5
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), *(c for c in ("text", "place", "audit")))
    assert conversations.report(turns).count() == 21


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert kept(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)), docs, "shard", "slot") == 21
