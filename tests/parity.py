"""Rows of a query against its SQL in DuckDB."""

import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from read_parquet('{sf_dir}/{name}')")
    return con


def text(x):
    if x is None or x != x:
        return "null"
    return f"{x:.6f}" if isinstance(x, float) else str(x).lower() if isinstance(x, bool) else str(x)


def same(df, con, sql: str) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    cur = con.execute(sql)
    names = sorted(c[0] for c in cur.description)
    place = [[c[0] for c in cur.description].index(n) for n in names]
    want = sorted(tuple(text(r[i]) for i in place) for r in cur.fetchall())
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    got = sorted(tuple(text(x) for x in r) for r in df.select(*names).toPandas().astype(object).itertuples(index=False, name=None))
    if got == want:
        return ""
    return f"{len(got)} and {len(want)} rows; only here {sorted(set(got) - set(want))[:3]}; only there {sorted(set(want) - set(got))[:3]}"
