"""Comparing a query with its DuckDB SQL."""

import os

import duckdb


def rows_of(frame):
    """Rows as sorted tuples of columns in name order; numbers rounded."""
    names = sorted(frame[0])

    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        return str(v) if v is not None and not isinstance(v, int | bool) else v

    return sorted((tuple(plain(v) for _, v in sorted(zip(frame[0], r, strict=True))) for r in frame[1]), key=repr), names


def duck(sql, sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    relation = con.sql(sql)
    return relation.columns, con.execute(sql).fetchall()


def same(df, sql, sf):
    got = rows_of((df.columns, [tuple(r) for r in df.collect()]))
    want = rows_of(duck(sql, sf))
    assert got[1] == want[1]
    assert len(got[0]) == len(want[0])
    assert got[0] == want[0]
