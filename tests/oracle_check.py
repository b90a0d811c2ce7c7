"""Run registered queries on Spark and their SQL twins on DuckDB and compare.

Usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def ordered_rows(cols, rows):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(row[i]) for i in idx) for row in rows]
    return [cols[i] for i in idx], sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(df, con, sql):
    scols, srows = ordered_rows(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(sql)
    dcols, drows = ordered_rows([c[0] for c in cur.description], cur.fetchall())
    if scols != dcols:
        return f"columns {scols} != {dcols}", len(srows)
    if len(srows) != len(drows):
        return f"rows {len(srows)} != {len(drows)}\n spark {srows[:2]}\n duck  {drows[:2]}", len(srows)
    for a, b in zip(srows, drows):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            diff = [(c, x, y) for c, x, y in zip(scols, a, b) if x != y or type(x) is not type(y)]
            bad = sum(1 for p, q in zip(srows, drows) if p != q)
            return f"values differ on {bad}/{len(srows)} rows; first: {diff}\n  row {a}", len(srows)
    return None, len(srows)


def session():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    import __spark_entry__ as entry
    spark, con = session(), duck(sf)
    sql = entry.oracle_sql()
    fails = 0
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            if name in sql:
                err, n = compare(fn(spark, sf), con, sql[name])
            else:
                err, n = None, fn(spark, sf).count()
        except Exception as e:  # report and go on
            err, n = f"{type(e).__name__}: {str(e)[:900]}", -1
        fails += err is not None
        print(f"{'FAIL' if err else 'ok  '} {name:34s} rows={n:<7d} {time.time() - t:5.1f}s"
              f"{'' if name in sql else ' (no sql)'}{'  ' + err if err else ''}", flush=True)
    print("failures:", fails)


if __name__ == "__main__":
    main()
