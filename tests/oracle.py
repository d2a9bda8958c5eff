"""Hold registered queries against DuckDB on the same tables, as sorted values."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or isinstance(v, bool | str):
        return repr(v)
    return f"{float(v):.9g}"


def assert_same(df, con, sql: str) -> None:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = sorted(tuple(_plain(r[i]) for i in at) for r in found.fetchall())
    assert sorted(tuple(map(_plain, r)) for r in df.collect()) == want
