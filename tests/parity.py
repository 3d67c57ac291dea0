"""Runs queries against their DuckDB SQL: python -m tests.parity [sf_dir] [name ...]"""

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb


def views(sf_dir):
    db = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else str(p) + '/*.parquet'}'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(spark, db, query, sql, sf_dir):
    """None, or what differs."""
    got = query(spark, sf_dir)
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} / {sorted(names)}"
    want = sorted(repr(tuple(map(plain, r))) for r in result.fetchall())
    rows = sorted(repr(tuple(map(plain, r))) for r in got.select(*[f"`{n}`" for n in names]).collect())
    if rows != want:
        odd = next((x for x in zip(rows, want) if x[0] != x[1]), None)
        return f"rows {len(rows)} / {len(want)}: {odd}"
    return None


if __name__ == "__main__":
    from calibra.registry import ORACLE_SQL, QUERIES
    from calibra.session import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db = views(sf_dir)
    for name in sys.argv[2:] or QUERIES:
        t = time.time()
        try:
            said = compare(spark, db, QUERIES[name], ORACLE_SQL[name], sf_dir) if name in ORACLE_SQL else f"no SQL; {QUERIES[name](spark, sf_dir).count()} rows"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{name}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
