"""Run the named queries beside their SQL twins and compare rows, columns and values.

usage: check_queries.py [--dir DIR] [name or module prefix ...]
"""

from __future__ import annotations

import argparse
import importlib
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("EVIDRA_CHECKPOINT_DIR", "/tmp/evidra-checkpoints")

import duckdb  # noqa: E402

from evidra.session import local_session  # noqa: E402
from evidra.tables import NAMES  # noqa: E402


def norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return ("f", None if math.isnan(value) else round(value, 9) + 0.0)
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return (type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--dir", default="/root/testdata/sf0.01")
    ap.add_argument("--module", default=None)
    ap.add_argument("--no-oracle", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from evidra.plans import registry
    if args.module:
        for module in args.module.split(","):
            importlib.import_module(f"evidra.plans.{module}")
    else:
        importlib.import_module("evidra.plans")
    names = args.names or list(registry.QUERIES)
    spark = local_session()
    db = duckdb.connect()
    for t in NAMES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.dir}/{t}.parquet'")
    bad = []
    for name in names:
        start = time.time()
        try:
            df = registry.QUERIES[name](spark, args.dir)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - start
            sql = None if args.no_oracle else registry.ORACLES.get(name)
            if sql is None:
                print(f"rows-only {name}: {len(got)} rows {took:.1f}s {df.columns}", flush=True)
                continue
            start = time.time()
            cur = db.execute(sql)
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            sql_took = time.time() - start
            if sorted(cols) != sorted(df.columns):
                bad.append(name)
                print(f"COLUMNS {name}: spark={sorted(df.columns)} sql={sorted(cols)}", flush=True)
                continue
            odd = [c for c in cur.description if str(c[1]).upper() in ("HUGEINT", "DECIMAL", "DATE")]
            a, b = rows_of(df.columns, got), rows_of(cols, want)
            if a == b:
                print(f"ok {name}: {len(a)} rows {took:.1f}s (sql {sql_took:.1f}s){' EMPTY' if not a else ''}{' ODDTYPES ' + str(odd) if odd else ''}", flush=True)
            else:
                bad.append(name)
                print(f"DIFF {name}: spark {len(a)} rows, sql {len(b)} rows {took:.1f}s; columns {sorted(cols)}", flush=True)
                sa, sb = set(map(repr, a)), set(map(repr, b))
                for x in sorted(sa - sb)[:3]:
                    print("   spark only:", x[:400])
                for x in sorted(sb - sa)[:3]:
                    print("   sql only:  ", x[:400])
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"ERROR {name}: {str(e)[:700]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
