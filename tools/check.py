"""Run registered queries and compare each with its SQL in DuckDB.

usage: python tools/check.py [sf] [name-part ...]
"""

from __future__ import annotations

import importlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetpulse.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6))
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(cell(i) for i in x) + "]"
    return str(x)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got[1]), ""
    res = con.execute(sql)
    want = canon([d[0] for d in res.description], res.fetchall())
    if got == want:
        return True, len(got[1]), ""
    if got[0] != want[0]:
        return False, len(got[1]), f"columns {got[0]} vs {want[0]}"
    a, b = set(got[1]), set(want[1])
    return False, len(got[1]), f"rows {len(got[1])} vs {len(want[1])}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    mods = [p[4:] for p in parts if p.startswith("mod:")]
    names = [p for p in parts if not p.startswith("mod:")]
    if mods:
        sys.modules.setdefault("fleetpulse.plans.catalog", type(sys)("fleetpulse.plans.catalog")).__path__ = [
            os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "fleetpulse/plans/catalog")]
        for m in mods:
            importlib.import_module(f"fleetpulse.plans.catalog.{m}")
    else:
        import fleetpulse.plans.catalog  # noqa: F401
    from fleetpulse.plans.catalog.registry import QUERIES, SQL

    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = oracle(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            ok, n, why = compare(spark, con, sf_dir, fn, SQL.get(name))
        except Exception as e:  # report and go on
            ok, n, why = False, -1, f"{type(e).__name__}: {str(e)[:600]}"
        bad += ok is False
        print(f"{'ok ' if ok else 'ROWS' if ok is None else 'FAIL'} {name} rows={n} {time.time() - t:.1f}s {why}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
