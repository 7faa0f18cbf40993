"""A query's rows against those of its SQL in DuckDB."""

import math
import os

import duckdb


def plain(rows):
    return sorted(tuple("null" if v is None or isinstance(v, float) and math.isnan(v) else str(v) for v in r) for r in rows)


def compare(spark, sf, query, sql):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    df = query(spark, sf)
    columns = sorted(df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    wanted = plain([[dict(zip(names, r))[c] for c in sorted(names)] for r in cursor.fetchall()])
    assert columns == sorted(names)
    assert plain([[r[c] for c in columns] for r in df.collect()]) == wanted
