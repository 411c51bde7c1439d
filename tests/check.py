"""Run registered queries next to their SQL and compare: python tests/check.py [-d DIR] [names]."""

from __future__ import annotations

import argparse
import datetime as dt
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(df, con, sql) -> str:
    """'' when equal, else what differs."""
    got_cols, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} / {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}; first {str(got[:1])[:300]} / {str(want[:1])[:300]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    types = {(type(a).__name__, type(b).__name__) for g, w in zip(got, want)
             for a, b in zip(g, w) if type(a) is not type(b) and a is not None and b is not None}
    if bad:
        g, w = bad[0]
        diff = [(c, a, b) for c, a, b in zip(got_cols, g, w) if a != b]
        return f"{len(bad)} of {len(got)} rows differ: {str(diff)[:700]}"
    return f"types {types}" if types else ""


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cores}]").appName("check")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args.names or any(n.startswith(a) for a in args.names)]
    spark, con, failed = session(), connect(args.d), []
    for n in names:
        t = time.time()
        try:
            df = queries[n](spark, args.d)
            said = compare(df, con, sql[n]) if n in sql else f"rows only: {df.count()}"
        except Exception as e:  # keep going, report at the end
            said = f"{type(e).__name__}: {str(e)[:700]}"
        ok = not said or said.startswith("rows only")
        failed += [] if ok else [n]
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t:.1f}s {said}", flush=True)
    print(f"{len(names) - len(failed)} ok, {len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
