"""Run registered queries next to their DuckDB SQL and compare every value.

    python tests/oracle_check.py [name-part ...]     (CHECK_SF=0.01 by default)
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:19].replace(" 00:00:00", "")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple((x is None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=key)


SPARK_SECONDS = [0.0]


def compare(df, con, sql):
    """'' when both agree, else a short account of the difference."""
    start = time.time()
    s_cols, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    SPARK_SECONDS[0] = time.time() - start
    cur = con.execute(sql)
    d_cols, d_rows = rows_of([c[0] for c in cur.description], cur.fetchall())
    if s_cols != d_cols:
        return f"columns {s_cols} vs {d_cols}"
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} vs {len(d_rows)}; spark {s_rows[:2]} duck {d_rows[:2]}"
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    if bad:
        only_s = sorted(set(s_rows) - set(d_rows), key=key)
        only_d = sorted(set(d_rows) - set(s_rows), key=key)
        return f"{len(only_s)} of {len(s_rows)} rows differ {s_cols}\n   spark {only_s[:3]}\n   duck  {only_d[:3]}"
    return "" if s_rows else "EMPTY"


def main(parts):
    from tests.conftest import build_session
    from __spark_entry__ import oracle_sql, queries

    sf_dir = f"/root/testdata/sf{os.environ.get('CHECK_SF', '0.01')}"
    spark, con = build_session(), duck(sf_dir)
    oracle, failed = oracle_sql(), []
    for name, build in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracle:
                out = compare(df, con, oracle[name])
                state = "ok" if not out else out if out == "EMPTY" else "FAIL " + out
            else:
                got = df.collect()
                state = f"rows-only {len(got)} {str(got[:2])[:400]}"
        except Exception as e:  # report and go on to the next query
            state = "FAIL " + str(e)[:1500]
        if state.startswith("FAIL") or state == "EMPTY":
            failed.append(name)
        print(f"{name:40s} {time.time() - start:6.2f}s ({SPARK_SECONDS[0]:.2f}) {state}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
