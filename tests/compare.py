"""Run catalogue queries in Spark and DuckDB and compare whole results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


SPENT = [0.0]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    t = time.time()
    names, got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    SPENT[:] = [time.time() - t]
    rel = con.sql(sql)
    want_names, want = _rows(rel.columns, rel.fetchall())
    if names != want_names:
        return [f"columns {names} != {want_names}"]
    out = []
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    a, b = set(map(repr, got)), set(map(repr, want))
    out += [f"only spark: {x[:700]}" for x in sorted(a - b)[:3]]
    out += [f"only sql:   {x[:700]}" for x in sorted(b - a)[:3]]
    if not out and [repr(x) for x in got] != [repr(x) for x in want]:
        out.append("multiset differs")
    return out


if __name__ == "__main__":
    import __spark_entry__ as entry
    from groundline.session import get_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = sys.argv[1:] or list(queries)
    bad = 0
    for name in names:
        t = time.time()
        try:
            if name in sqls:
                diff = differences(queries[name](spark, folder), con, sqls[name])
            else:
                diff = [] if queries[name](spark, folder).count() >= 0 else ["no rows"]
        except Exception as e:  # noqa: BLE001
            diff = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - t:.2f}s (spark {SPENT[0]:.2f}s)", flush=True)
        for line in diff:
            print("     ", line)
    print("failed:", bad)
