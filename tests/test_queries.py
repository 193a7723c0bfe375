"""Every registered query against its SQL, row for row, on the smallest data."""

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

import queries  # noqa: E402
from compare import compare, connect  # noqa: E402

queries.load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLES:
        assert compare(df, con, queries.ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_every_check_belongs_to_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = {r["table_name"]: r for r in entry.entry(spark).collect()}
    assert len(rows) == 7
    assert rows["lineitem"]["data_match"] and rows["orders"]["status"] == "MISMATCH"
    assert rows["customer"]["status"] == "MATCH" and not rows["customer"]["data_match"]
    assert rows["supplier"]["row_count_match"] and not rows["supplier"]["data_match"]
