import pytest

from photonframe.llm import queries

from ..oracle import compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLES[name])
