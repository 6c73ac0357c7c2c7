"""Run registered queries in Spark and DuckDB on one data folder and compare the rows.

python tests/oracle.py SF_DIR [NAME...]
"""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = p + "/*.parquet" if os.path.isdir(p) else p
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    return c


def compare(spark, con, sf_dir, name, query, sql):
    t = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    rel = con.sql(sql)
    want = rel.fetchall()
    a, b = rows_of(df.columns, got), rows_of(rel.columns, want)
    problem = ""
    if sorted(df.columns) != sorted(rel.columns):
        problem = f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    elif a != b:
        sa, sb = set(a), set(b)
        problem = f"{len(a)} rows against {len(b)}; only here {list(sa - sb)[:3]}; only there {list(sb - sa)[:3]}"
    return problem, len(a), took


if __name__ == "__main__":
    import __spark_entry__ as e
    from arborix.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    con = duck(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for n in sys.argv[2:] or qs:
        if n not in sqls:
            t = time.time()
            k = qs[n](spark, sf).count()
            print(f"{n}: {k} rows, no SQL, {time.time() - t:.1f} s", flush=True)
            continue
        why, k, took = compare(spark, con, sf, n, qs[n], sqls[n])
        bad += bool(why)
        print(f"{n}: {'DIFFERS ' + why if why else 'same'}, {k} rows, {took:.1f} s", flush=True)
    sys.exit(bad > 0)
