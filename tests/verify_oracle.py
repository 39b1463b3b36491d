"""Compare registered queries with their SQL: python tests/verify_oracle.py [sf] [name prefix ...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind:
            return f"type of {c}: {a[c].dtype} != {b[c].dtype}"
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            n = int((~same).sum())
            i = same.idxmin()
            return f"{n} values differ in {c}: {x[i]!r} != {y[i]!r} at {a.iloc[i].to_dict()}"
    return ""


def main() -> int:
    from barloom.session import local_session
    from barloom.workbench.oracle import oracle_sql
    from barloom.workbench.queries import QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET threads = 4")
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    sql = oracle_sql()
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            odd = [f.simpleString() for f in df.schema if f.dataType.simpleString() not in ("bigint", "double", "string", "boolean")]
            assert not odd, f"types {odd}"
            got = df.toPandas()
            spent = time.time() - t
            if name not in sql:
                print(f"  rows {name}: {len(got)} ({spent:.1f}s)", flush=True)
                continue
            problem = compare(got, con.execute(sql[name]).df())
        except Exception as error:  # noqa: BLE001
            spent, problem = time.time() - t, f"{type(error).__name__}: {str(error)[:600]}"
            got = ()
        bad += bool(problem) or not len(got)
        print(f"{'FAIL' if problem else 'ok  ' if len(got) else 'EMPTY'} {name}: {len(got)} rows ({spent:.1f}s) {problem}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(main())
