import pytest

from larkspan.plans.more import ORACLE, QUERIES
from tests.oracle import differences


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
