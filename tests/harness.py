"""Spark-vs-DuckDB comparison in the shape of the driver's check: row count,
column names, and an order-insensitive hash of the values (columns sorted by
name). Usable from pytest and as a script:

    python tests/harness.py [sf_dir] [query ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return str(v)


def digest(cols: list[str], rows) -> tuple[int, str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return len(lines), h


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    import __spark_entry__ as E
    con = con or duck(sf_dir)
    t = time.time()
    sdf = E.queries()[name](spark, sf_dir)
    srows = sdf.collect()
    scols = sdf.columns
    t_spark = time.time() - t
    sql = E.oracle_sql().get(name)
    out = {"query": name, "spark_rows": len(srows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        out["oracle"] = "none"
        return out
    rel = con.sql(sql)
    drows = rel.fetchall()
    dcols = list(rel.columns)
    n1, h1 = digest(scols, srows)
    n2, h2 = digest(dcols, drows)
    out.update(duck_rows=n2, cols_match=sorted(scols) == sorted(dcols),
               hash_match=h1 == h2 and n1 == n2)
    if not out["cols_match"]:
        out["cols"] = (sorted(scols), sorted(dcols))
    if not out["hash_match"]:
        order_s = sorted(range(len(scols)), key=lambda i: scols[i])
        order_d = sorted(range(len(dcols)), key=lambda i: dcols[i])
        a = sorted("\x1f".join(_norm(r[i]) for i in order_s) for r in srows)
        b = sorted("\x1f".join(_norm(r[i]) for i in order_d) for r in drows)
        diff_a = [x for x in a if x not in set(b)][:3]
        diff_b = [x for x in b if x not in set(a)][:3]
        out["example_spark_only"] = [x[:300] for x in diff_a]
        out["example_duck_only"] = [x[:300] for x in diff_b]
    return out


if __name__ == "__main__":
    from moodframe.session import local_session
    import __spark_entry__ as E

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(E.queries())
    spark = local_session(8)
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf, con)
        except Exception as e:  # report and continue
            r = {"query": n, "error": repr(e)[:500]}
        ok = r.get("hash_match", r.get("oracle") == "none") and "error" not in r
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
