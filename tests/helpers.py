"""What the tests share."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(df):
    names = sorted(df.columns)
    return sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())


def _plain(v):
    return repr(round(v, 6) + 0.0 if isinstance(v, float) else v)


def oracle_rows(sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(tuple(_plain(r[i]) for i in order) for r in found.fetchall())
