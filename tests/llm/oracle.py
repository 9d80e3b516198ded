"""DuckDB over the tables of a folder, for comparing a query with its SQL."""

from pathlib import Path

import duckdb


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    rel = con.sql(sql)
    return sorted([tuple(r[rel.columns.index(c)] for c in sorted(rel.columns)) for r in rel.fetchall()], key=repr)


def spark_rows(df):
    return sorted([tuple(r[c] for c in sorted(df.columns)) for r in df.collect()], key=repr)
