import os

import duckdb
import pytest

from gneiss.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.5f}"
    return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = catalogue.queries()[name](spark, SF)
    said = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in said.description]
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, df.collect()) == table(names, said.fetchall())
