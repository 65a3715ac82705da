"""Runs catalogue queries on Spark and their verification SQL on DuckDB and compares the rows.

usage: python tools/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from barcheck.plans.catalog import catalog  # noqa: E402
from barcheck.session import local_session, use_utc  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, list):
        return str([norm(x) for x in v])
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = local_session()
    use_utc(spark)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.sf}/{t}.parquet'")
    bad = 0
    for name, (fn, sql) in catalog().items():
        if a.names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in a.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, a.sf)
            got = df.collect()
            dt = time.time() - t0
            if sql is None:
                print(f"rows-only {name}: {len(got)} rows {dt:.1f}s")
                continue
            t1 = time.time()
            cur = con.execute(sql)
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            du = time.time() - t1
            msg = []
            if sorted(cols) != sorted(df.columns):
                msg.append(f"columns {sorted(df.columns)} vs {sorted(cols)}")
            else:
                x, y = rows_of(df.columns, [tuple(r) for r in got]), rows_of(cols, want)
                if x != y:
                    sx, sy = set(x), set(y)
                    msg.append(f"rows {len(x)} vs {len(y)}; only spark {[r for r in x if r not in sy][:2]}; only sql {[r for r in y if r not in sx][:2]}")
            types = {d[0]: str(d[1]) for d in cur.description}
            wide = [f"{c}:{t}" for c, t in types.items() if "HUGEINT" in t or "DECIMAL" in t]
            bad += bool(msg)
            print(("FAIL " if msg else "ok   ") + f"{name}: {len(got)} rows spark {dt:.1f}s duckdb {du:.1f}s {wide or ''} {' '.join(msg)}"[:1500], flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name}: {type(e).__name__} {str(e)[:900]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
