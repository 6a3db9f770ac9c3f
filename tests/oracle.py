"""Comparison of a query with its SQL."""

import decimal


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def same(df, con, sql):
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(v) for v in row)) for row in df.select(*[f"`{n}`" for n in names]).collect())
    cursor = con.execute(sql)
    found = [c[0] for c in cursor.description]
    assert sorted(found) == names
    at = [found.index(n) for n in names]
    want = sorted(repr(tuple(plain(row[i]) for i in at)) for row in cursor.fetchall())
    assert got == want
