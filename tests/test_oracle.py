import pytest

import __spark_entry__
from locweave.plans import desk, files, inventory, kept, streams, workflow

from .oracle import duck, rows_of

FOLDER = "/root/testdata/sf0.001"
SQL = {**inventory.SQL, **desk.SQL, **workflow.SQL, **files.SQL, **streams.SQL, **kept.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    frame = __spark_entry__.queries()[name](spark, FOLDER)
    names, rows = duck(SQL[name], FOLDER)
    assert sorted(frame.columns) == names
    assert rows_of(frame) == rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_folds_have_rows(spark):
    for name in set(streams.QUERIES) - set(streams.SQL):
        assert __spark_entry__.queries()[name](spark, FOLDER).count() > 0
