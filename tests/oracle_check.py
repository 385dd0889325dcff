"""Run registered Spark jobs against their DuckDB oracle SQL and compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]

Comparison: row count, column names, column families and the multiset of
rows (columns sorted by name; doubles compared exactly and, separately,
to 1e-9 relative so a last-bit difference is visible but distinguishable).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents",
          "benchmark", "labels"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v
    if isinstance(v, float) and v == 0.0:
        return 0.0
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, str(v)) if not isinstance(v, (int, float)) else (1, f"{v:.6f}")
                 for v in row)


def _close(a, b, exact):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        if isinstance(a, float) and math.isnan(a) and isinstance(b, float) and math.isnan(b):
            return True
        if exact:
            return float(a) == float(b)
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    problems = []
    if sorted(spark_cols) != sorted(duck_cols):
        return [f"columns differ: spark={sorted(spark_cols)} duck={sorted(duck_cols)}"], False
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    s = sorted((tuple(_norm(r[i]) for i in si) for r in spark_rows), key=_key)
    d = sorted((tuple(_norm(r[i]) for i in di) for r in duck_rows), key=_key)
    if len(s) != len(d):
        problems.append(f"row count spark={len(s)} duck={len(d)}")
        return problems, False
    exact = True
    for a, b in zip(s, d):
        for c, x, y in zip(order, a, b):
            if not _close(x, y, exact=False):
                problems.append(f"value {c}: spark={x!r} duck={y!r}")
                break
            if not _close(x, y, exact=True):
                exact = False
        if len(problems) > 5:
            break
    return problems, exact


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from tillroll.session import local_session
    import __spark_entry__ as E
    spark = local_session(8)
    jobs, sqls = E.queries(), E.oracle_sql()
    jobs = {k: v for k, v in jobs.items() if k in sqls}  # the others are tested against brute force
    con = duck(sf_dir)
    bad = 0
    for name in (names or list(jobs)):
        t0 = time.time()
        try:
            df = jobs[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"ROWS {name}: {len(rows)} rows (no oracle) {t1 - t0:.1f}s")
            continue
        try:
            res = con.execute(sqls[name])
            drows = res.fetchall()
            dcols = [d[0] for d in res.description]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        problems, exact = compare(rows, cols, drows, dcols)
        if problems:
            bad += 1
            print(f"FAIL {name}: " + " | ".join(problems[:4]))
        else:
            print(f"OK   {name}: {len(rows)} rows{'' if exact else ' (last-bit float diffs)'} {t1 - t0:.1f}s")
    print(f"{bad} failing")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
