import os

import pytest

from lodestar.llm import queries

from ..oracle import check

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    check(spark, FOLDER, queries.queries()[name], queries.oracle_sql()[name])
