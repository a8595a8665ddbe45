import os

import pytest

from lodestone.llm import queries as llm

from .. import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_sql(spark, name):
    oracle.assert_equal(spark, llm.queries()[name], llm.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_runs(spark, name):
    df = llm.queries()[name](spark, oracle.DATA)
    rows = df.count()
    assert rows > 0
    if name.endswith("_found"):
        assert df.distinct().count() == rows
