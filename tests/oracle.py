"""Compare registered Spark queries with their reference SQL: python -m tests.oracle [--sf DIR] [names or prefixes]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "is_finite"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(canon(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(canon(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=lambda r: tuple(str(x) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    if sql is None:
        return None, len(got), 0
    res = con.execute(sql)
    exp_cols, exp = rows_of([c[0] for c in res.description], res.fetchall())
    if got_cols != exp_cols:
        return f"columns {got_cols} != {exp_cols}", len(got), len(exp)
    if len(got) != len(exp):
        only = list(set(got) - set(exp))[:2], list(set(exp) - set(got))[:2]
        return f"rows {len(got)} != {len(exp)} {only}", len(got), len(exp)
    for a, b in zip(got, exp):
        if a != b:
            bad = [(c, x, y) for c, x, y in zip(got_cols, a, b) if x != y]
            n = sum(1 for p, q in zip(got, exp) if p != q)
            return f"{n} differ, first {bad[:4]} in {a[:4]}", len(got), len(exp)
    return "", len(got), len(exp)


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from orderlens.session import get_session
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                              "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    names = [n for n in qs if not argv or any(n.startswith(a) for a in argv)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            msg, g, x = compare(spark, con, n, qs[n], sqls.get(n), sf)
        except Exception as ex:  # noqa: BLE001
            msg, g, x = f"{type(ex).__name__} {str(ex)[:700]}", -1, -1
        state = "rows-only" if msg is None else ("ok" if msg == "" else "FAIL " + msg)
        bad += bool(msg)
        print(f"{n:36s} {g:8d} {time.time() - t:6.1f}s {state}", flush=True)
    print("queries", len(names), "failed", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
