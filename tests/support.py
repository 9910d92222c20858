"""Comparison of a query's rows with those of its SQL in DuckDB."""

import decimal
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.6g}" if v else "0"
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") and hasattr(v, "tzinfo") else str(v)


def same_rows(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(v) for _, v in sorted(zip(names, r))]) for r in cur.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert got == want
