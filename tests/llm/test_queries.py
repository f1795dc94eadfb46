import pytest

from pulseloom.llm import queries as Q
from tests.helpers import same_as_sql


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_query_equals_sql(name, spark, sf_dir, duck):
    same_as_sql(Q.queries()[name](spark, sf_dir), duck, Q.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in Q.queries() if n not in Q.oracle_sql()])
def test_query_without_sql_runs(name, spark, sf_dir):
    assert Q.queries()[name](spark, sf_dir).count() > 0
