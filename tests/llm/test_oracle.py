import pytest

from mosslight.llm.oracle import ORACLE_SQL
from mosslight.llm.queries import QUERIES
from tests.compare import DATA, check


@pytest.mark.skipif(not DATA.exists(), reason="the benchmark tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name])
