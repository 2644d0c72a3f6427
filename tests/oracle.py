"""Holds a query's rows against its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def same(df, sql, sf_dir):
    got = df.select(sorted(df.columns)).collect()
    names = [d[0] for d in connect(sf_dir).execute(f"DESCRIBE {sql}").fetchall()]
    assert sorted(names) == sorted(df.columns)
    want = connect(sf_dir).execute(f"SELECT {', '.join(f'"{n}"' for n in sorted(names))} FROM ({sql})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got, want = (sorted((tuple(map(_plain, r)) for r in rows), key=key) for rows in (got, want))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w
    return len(got)
