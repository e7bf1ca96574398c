"""Run queries() against oracle_sql() the way the driver's correctness gate does.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive multiset of values.
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == int(v) and abs(v) < 2**53:
            return int(v)
        return round(v, 6)
    if hasattr(v, "item"):  # numpy scalar
        return _norm(v.item())
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return str(v)
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in records:
        out.append(tuple(_norm(r[i]) for i in order))
    return sorted(out, key=repr), sorted(columns)


def compare(spark, con, name, fn, sql, sf_dir, show=3):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    cols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return {"name": name, "ok": None, "rows": len(srows), "spark_s": round(t1 - t0, 2)}
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    a, ac = rows_of(cols, srows)
    b, bc = rows_of(ocols, orows)
    res = {"name": name, "rows": len(a), "oracle_rows": len(b), "spark_s": round(t1 - t0, 2)}
    if ac != bc:
        res.update(ok=False, why=f"columns {ac} vs {bc}")
        return res
    if a == b:
        res["ok"] = True
        return res
    res["ok"] = False
    sa, sb = set(a), set(b)
    only_a = [x for x in a if x not in sb][:show]
    only_b = [x for x in b if x not in sa][:show]
    res["why"] = f"rows {len(a)} vs {len(b)}; spark-only {only_a!r:.1500}; oracle-only {only_b!r:.1500}"
    return res


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            names.append(a)
    import __spark_entry__ as E
    from pagemill.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8, extra={"spark.ui.showConsoleProgress": "false"})
    con = duck(sf_dir)
    qs, ors = E.queries(), E.oracle_sql()
    bad = 0
    for n in (names or list(qs)):
        try:
            r = compare(spark, con, n, qs[n], ors.get(n), sf_dir)
        except Exception as e:  # report and go on
            r = {"name": n, "ok": False, "why": f"{type(e).__name__}: {str(e)[:800]}"}
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print(f"FAILED {bad} of {len(names or qs)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
