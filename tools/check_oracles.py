"""Run registered queries and their SQL on one data folder and compare the rows.

    python tools/check_oracles.py /path/to/sf0.01 [name prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from uipatterns.catalog import ORACLES, QUERIES  # noqa: E402
from uipatterns.session import build_session  # noqa: E402


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return float(v) if isinstance(v, int) else v


def main() -> int:
    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in pathlib.Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            rows = df.collect()
            cols = sorted(df.columns)
            mine = sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=repr)
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name}: {len(mine)} rows {took:.1f}s", flush=True)
                bad += not mine
                continue
            cur = con.execute(ORACLES[name])
            names = [d[0] for d in cur.description]
            theirs = [dict(zip(names, r)) for r in cur.fetchall()]
            if sorted(names) != cols:
                print(f"FAIL  {name}: columns {cols} / {sorted(names)}", flush=True)
                bad += 1
                continue
            other = sorted((tuple(norm(r[c]) for c in cols) for r in theirs), key=repr)
            if mine == other and mine:
                print(f"ok    {name}: {len(mine)} rows {took:.1f}s", flush=True)
            else:
                bad += 1
                a, b = set(mine), set(other)
                print(f"FAIL  {name}: {len(mine)} / {len(other)} rows {cols}; only ours {sorted(a - b, key=repr)[:3]}; only SQL {sorted(b - a, key=repr)[:3]}", flush=True)
        except Exception as e:
            bad += 1
            print(f"ERROR {name}: {str(e)[:700]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
