"""Every registered query of the trust engine against its SQL."""

from pathlib import Path

import duckdb
import pytest

from attesta import catalog

SF = "/root/testdata/sf0.001"


def sql_rows(sql):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    rel = con.sql(sql)
    return sorted([tuple(r[rel.columns.index(c)] for c in sorted(rel.columns)) for r in rel.fetchall()], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted([tuple(r[c] for c in sorted(df.columns)) for r in df.collect()], key=repr)
    assert got == sql_rows(catalog.ORACLE_SQL[name])


def test_entry_lists_everything():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.ORACLE_SQL) <= set(e.oracle_sql())
