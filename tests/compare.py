"""Holds a query against its SQL, run by DuckDB over the same tables."""

import os

import duckdb

DATA = "/root/testdata"


def plain(rows):
    return sorted([tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows], key=lambda r: tuple((x is not None, str(x)) for x in r))


def matches(spark, query, sql, sf="sf0.001"):
    folder = f"{DATA}/{sf}"
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    df = query(spark, folder)
    names = sorted(df.columns)
    rel = con.sql(sql)
    assert names == sorted(rel.columns)
    found = plain(tuple(r[c] for c in names) for r in df.collect())
    wanted = plain(con.sql("select " + ", ".join(f'"{c}"' for c in names) + f" from ({sql})").fetchall())
    assert found == wanted
