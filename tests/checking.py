"""Holds a query against its SQL in DuckDB, as sorted rows of rounded values."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}") + 0.0
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def connected(sf_dir):
    con = duckdb.connect(config={"memory_limit": "2GB", "threads": 2})
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    want = con.execute(sql)
    names = [x[0] for x in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    return got
