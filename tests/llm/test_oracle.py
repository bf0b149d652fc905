import pytest

from locweave.llm.queries import ORACLES, QUERIES

from ..oracle import duck, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    names, rows = duck(ORACLES[name], FOLDER)
    assert sorted(frame.columns) == names
    assert rows_of(frame) == rows
