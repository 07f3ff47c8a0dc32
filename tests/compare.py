"""Comparison of a Spark result with a DuckDB result: equal columns and equal rows in any order."""

import math


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return f"{v:.6f}"
    return v if isinstance(v, str) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def same(df, con, sql):
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    got, want = rows(df.columns, df.collect()), rows(found.columns, found.fetchall())
    assert len(got) == len(want)
    assert got == want
