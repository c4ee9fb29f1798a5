"""Run registered queries against their SQL checks: python tools/check_queries.py SF_DIR [name-prefix ...]"""

import datetime
import decimal
import math
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb

from searchloom.plans import ORACLES, QUERIES, load_all
from searchloom.plans.tables import TABLES
from searchloom.session import local_session


def norm(v):
    if isinstance(v, (decimal.Decimal,)):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.12g}")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name, sf):
    t = time.time()
    df = QUERIES[name](spark, sf)
    data = [tuple(r) for r in df.collect()]
    spent = time.time() - t
    sc, sr = rows(df.columns, data)
    types = {c: t for c, t in df.dtypes}
    if name not in ORACLES:
        return f"rows-only n={len(sr)}", spent, len(sr) > 0
    t = time.time()
    cur = con.execute(ORACLES[name])
    dc, dr = rows([d[0] for d in cur.description], cur.fetchall())
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    osp = time.time() - t
    wide = [f"{c}:{dtypes[c]}" for c in dtypes if "HUGE" in dtypes[c] or "DECIMAL" in dtypes[c]]
    if sc != dc:
        return f"COLUMNS {sc} vs {dc}", spent, False
    if len(sr) != len(dr):
        return f"COUNT {len(sr)} vs {len(dr)}; spark-only {[x for x in sr if x not in set(dr)][:2]} oracle-only {[x for x in dr if x not in set(sr)][:2]}", spent, False
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"VALUES {len(bad)}/{len(sr)} {sc} {bad[:2]}", spent, False
    return f"ok n={len(sr)} oracle={osp:.1f}s {' WIDE ' + str(wide) if wide else ''}{'' if sr else ' EMPTY'}", spent, not wide


def main():
    sf, prefixes = sys.argv[1], sys.argv[2:]
    load_all()
    spark = local_session()
    spark.conf.set("spark.sql.session.timeZone", os.environ.get("CHECK_TZ", "UTC"))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    failed = []
    for name in QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            msg, spent, ok = compare(spark, con, name, sf)
        except Exception as exc:  # noqa: BLE001
            msg, spent, ok = f"ERROR {type(exc).__name__} {str(exc)[:700]}", 0, False
        print(f"{'PASS' if ok else 'FAIL'} {name} {spent:.1f}s {msg}", flush=True)
        if not ok:
            failed.append(name)
    print("FAILED", failed)


if __name__ == "__main__":
    main()
