import os

import pytest

import __spark_entry__
from lodestar import queries

from .oracle import check

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    check(spark, FOLDER, queries.QUERIES[name], queries.SQL[name])


def test_queries_without_sql(spark):
    assert sorted(set(queries.QUERIES) - set(queries.SQL)) == ["embed_documents", "pipeline_answer"]
    vectors = queries.QUERIES["embed_documents"](spark, FOLDER).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in vectors)
    answers = {r.question: r for r in queries.QUERIES["pipeline_answer"](spark, FOLDER).collect()}
    assert {r.operation for r in answers.values()} == {"aggregate_sum", "count", "spof", "exhaustive_list"}
    assert answers["How many companies are there in Cat 1?"].answer == "There are 3."


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
