from pathlib import Path

import pytest

from frameloom.llm.oracle import ORACLE
from frameloom.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_queries_without_a_statement_are_known():
    assert set(QUERIES) - set(ORACLE) == {"p2_neighbours", "p6_ids", "p7_containers"}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_statement(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    a, b = QUERIES[name](spark, str(DATA)), c.sql(ORACLE[name])
    assert rows_of(a.columns, a.collect()) == rows_of(b.columns, b.fetchall())
