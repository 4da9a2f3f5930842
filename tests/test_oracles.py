"""Every query against its SQL in DuckDB."""

import pytest
from rows import TINY, table

from posturelake.plans import queries_core, queries_parse, queries_reports, registry  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, TINY).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)
