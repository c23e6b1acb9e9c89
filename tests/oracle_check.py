"""Compare the registered queries with their SQL checks: python tests/oracle_check.py [dir] [names...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype == object and len(df) and df[c].map(lambda x: hasattr(x, "__len__") and not isinstance(x, str)).any():
            df = df.assign(**{c: df[c].map(lambda x: None if x is None else repr(list(x)))})
    keys = df.astype(object).where(~df.isna(), None).astype(str)
    order = keys.sort_values(list(df.columns)).index
    return df.loc[order].reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = tidy(got), tidy(want)
    for c in got.columns:
        a, b = got[c], want[c]
        if a.dtype != b.dtype and len(a) and not (a.dtype == object or b.dtype == object):
            return f"type of {c}: {a.dtype} != {b.dtype}"
        na, nb = a.isna(), b.isna()
        same = (na & nb) | (a.astype(object).where(~na, None) == b.astype(object).where(~nb, None))
        if not same.all():
            i = same[~same].index[0]
            return f"{c}: {(~same).sum()} differ, first {a[i]!r} != {b[i]!r}\n{got.loc[i].to_dict()}\n{want.loc[i].to_dict()}"
    return None


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    import __spark_entry__ as entry
    from vecloom.session import build_session

    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(sf_dir)
    bad = 0
    for name, run in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            at = time.time()
            got = run(spark, sf_dir).toPandas()
            took = time.time() - at
            if name not in oracles:
                print(f"rows  {name} {len(got)} {took:.1f}s", flush=True)
                continue
            at = time.time()
            want = con.execute(oracles[name]).df()
            problem = difference(got, want)
            sql_took = time.time() - at
        except Exception as error:  # noqa: BLE001
            if os.environ.get("TRACE"):
                traceback.print_exc()
            problem, took, sql_took = f"{type(error).__name__}: {str(error)[:700]}", 0, 0
        bad += problem is not None
        print(f"{'ok   ' if problem is None else 'FAIL '} {name} {len(got) if problem is None else ''} {took:.1f}s sql {sql_took:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
