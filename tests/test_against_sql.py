"""Every query with SQL, on the smallest data, against DuckDB."""

import pytest

from workload.check import differences, oracle_rows, same_kind
from workload.oracle import oracle_sql
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    frame = QUERIES[name](spark, SF)
    rows = [tuple(row) for row in frame.collect()]
    names, types, expected = oracle_rows(SF, SQL[name])
    assert differences(frame.columns, rows, names, expected) is None
    kinds = dict(frame.dtypes)
    assert all(same_kind(kinds[n], t) for n, t in zip(names, types))


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
