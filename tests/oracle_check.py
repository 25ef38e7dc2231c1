"""Run registered queries and compare each with its DuckDB twin by value.

    python tests/oracle_check.py [sf_dir] [name-prefix …]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v: object) -> object:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _sorted_rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))


def compare(spark, con, query, sf_dir: str) -> tuple[str, str, float, int]:
    """(status, detail, seconds, rows); status is ok, rows (no twin) or DIFF."""
    t0 = time.time()
    df = query.run(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    secs = time.time() - t0
    sql = query.oracle()
    if sql is None:
        return "rows", "", secs, len(got_rows)
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return "DIFF", f"columns {sorted(df.columns)} vs {sorted(want_cols)}", secs, len(got_rows)
    got, want = _sorted_rows(df.columns, got_rows), _sorted_rows(want_cols, want_rows)
    if len(got) != len(want):
        return "DIFF", f"{len(got)} rows vs {len(want)}; first {got[:1]} / {want[:1]}", secs, len(got_rows)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return "DIFF", f"{len(bad)} of {len(got)} rows differ; {sorted(df.columns)}\n     {bad[0][0]}\n     {bad[0][1]}", secs, len(got_rows)
    return "ok", "", secs, len(got_rows)


def main() -> None:
    from marketspark.plans import load_all
    from marketspark.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    worst = 0
    for name, q in load_all().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            status, detail, secs, n = compare(spark, con, q, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            text = str(e).split("JVM stacktrace")[0]
            status, detail, secs, n = "ERROR", f"{type(e).__name__}: {text[:1200]}", 0.0, 0
        worst += status in ("DIFF", "ERROR")
        print(f"{status:6}{name:45}{n:8} rows {secs:7.2f}s {detail}", flush=True)
    print("failures:", worst)


if __name__ == "__main__":
    main()
