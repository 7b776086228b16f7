"""DuckDB over the same Parquet tables, and comparison by value."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def answer(sql: str, sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = c.execute(sql)
    return [x[0] for x in got.description], got.fetchall()


def same(df, sql: str, sf_dir: str) -> None:
    names, expected = answer(sql, sf_dir)
    columns = sorted(df.columns)
    assert sorted(names) == columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    plain = lambda x: float(x) if isinstance(x, float) else x
    mine = sorted((tuple(plain(x) for x in r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=key)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in expected), key=key)
    assert mine == theirs
