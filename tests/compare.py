"""Run registered queries on Spark and DuckDB and compare the rows."""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from collectra.inputs import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}" if v != int(v) else str(int(v))
    return str(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())


def differences(spark, con, sf_dir, fn, sql):
    """None when equal, else a short description."""
    names, got = rows_of_spark(fn(spark, sf_dir))
    wanted_names, wanted = rows_of_duck(con, sql)
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if got != wanted:
        a, b = set(got), set(wanted)
        return f"rows {len(got)} / {len(wanted)}; only spark {sorted(a - b)[:3]}; only duckdb {sorted(b - a)[:3]}"
    return None


def main(argv):
    from collectra.plans.registry import oracle_sql, queries
    from collectra.session import build_session

    sf = next((a[3:] for a in argv if a.startswith("sf=")), "0.001")
    wanted = [a for a in argv if not a.startswith("sf=")]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(cpus="8")
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls = duck(sf_dir), queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                diff = differences(spark, con, sf_dir, fn, sqls[name])
                n = con.execute(f"SELECT count(*) FROM ({sqls[name]})").fetchone()[0]
            else:
                diff, n = None, fn(spark, sf_dir).count()
        except Exception as e:  # keep going, report all
            diff, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        state = "FAIL" if diff else ("ok" if name in sqls else "rows-only")
        if diff or n == 0:
            bad += bool(diff)
            print(f"\n{state:9} {name} rows={n} {time.time() - start:.1f}s {diff or 'EMPTY'}", flush=True)
        else:
            print(f"\n{state:9} {name} rows={n} {time.time() - start:.1f}s", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
