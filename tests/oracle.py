"""Run registered queries beside their SQL on DuckDB and compare values.

    python tests/oracle.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _row(row, columns):
    out = []
    for c in columns:
        value = row[c]
        if isinstance(value, float) and math.isnan(value):
            value = "NaN"
        out.append(value)
    return tuple(out)


def _sorted(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    kinds = {str(c[1]) for c in result.description}
    if not kinds <= {"BIGINT", "DOUBLE", "VARCHAR", "NUMBER", "STRING"}:
        return f"types {kinds}"
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(names)} / {sorted(df.columns)}"
    columns = sorted(names)
    want = _sorted(_row(dict(zip(names, r)), columns) for r in result.fetchall())
    got = _sorted(_row(r.asDict(), columns) for r in df.collect())
    if len(want) != len(got):
        return f"rows: sql {len(want)}, spark {len(got)}"
    wrong = [(w, g) for w, g in zip(want, got) if w != g]
    if wrong:
        return f"{len(wrong)} of {len(want)} rows differ; {columns}; sql {wrong[0][0]} spark {wrong[0][1]}"
    return None


def main() -> int:
    from signalloom.catalog import ORACLES, QUERIES
    from signalloom.session import build_session, set_scratch

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": os.environ.get("ORACLE_PARTITIONS", "8"), "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                       "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    set_scratch(spark)
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        began = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in ORACLES:
                verdict = difference(df, con, ORACLES[name]) or "ok"
                rows = con.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0]
            else:
                rows = len(df.collect())
                verdict = "rows only"
        except Exception as error:  # report every query, then fail
            verdict, rows = f"ERROR {str(error)[:600]}", -1
        bad += verdict not in ("ok", "rows only")
        print(f"{name:36s} {time.time() - began:6.2f}s {rows:7d} {verdict}", flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
