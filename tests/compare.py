"""Spark-vs-DuckDB comparison used by the tests and by hand.

``python tests/compare.py [sf_dir] [key ...]`` runs each registered query and
its oracle SQL on the same Parquet tables and reports row count, column
names/kinds and an order-insensitive comparison of the values.
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck_connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, round(v, 6))
    if isinstance(v, bool):
        return (3, int(v))
    if isinstance(v, int):
        return (2, float(v))
    if hasattr(v, "isoformat"):
        return (4, v.isoformat()[:10] if type(v).__name__ == "date" else v.isoformat())
    return (5, str(v))


def rows_of(records, columns):
    order = sorted(columns)
    idx = [columns.index(c) for c in order]
    return sorted(tuple(_norm(r[i]) for i in idx) for r in records)


def in_order(records: list[dict], order: list[tuple[str, bool]]) -> bool:
    """Whether rows follow ``(column, descending)`` terms, NULLs last in each."""

    def step(a, b) -> int:
        for column, down in order:
            x, y = a[column], b[column]
            if x != y:
                return 1 if x is None else -1 if y is None else (x > y) - (x < y) if not down else (x < y) - (x > y)
        return 0

    return all(step(a, b) <= 0 for a, b in zip(records, records[1:], strict=False))


def compare(spark, con, key: str, sf_dir: str, fn, sql: str | None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    out = {"key": key, "spark_rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        out["oracle"] = None
        return out
    t0 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    out["duck_sec"] = round(time.time() - t0, 2)
    out["duck_rows"] = len(d_rows)
    out["cols_match"] = sorted(s_cols) == sorted(d_cols)
    if not out["cols_match"]:
        out["spark_cols"], out["duck_cols"] = s_cols, d_cols
        out["match"] = False
        return out
    a, b = rows_of(s_rows, s_cols), rows_of(d_rows, d_cols)
    out["match"] = a == b
    if not out["match"]:
        sa, sb = set(a), set(b)
        out["only_spark"] = [x for x in a if x not in sb][:3]
        out["only_duck"] = [x for x in b if x not in sa][:3]
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    import __spark_entry__ as E
    from attrition.session import build_session

    spark = build_session(
        "local[8]", shuffle_partitions=8, extra={"spark.ui.showConsoleProgress": "false"}
    )
    con = duck_connect(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for key in wanted or list(qs):
        try:
            r = compare(spark, con, key, sf_dir, qs[key], sqls.get(key))
        except Exception as e:  # report and go on
            r = {"key": key, "error": f"{type(e).__name__}: {str(e)[:300]}"}
        ok = r.get("match", r.get("oracle", "x") is None and "error" not in r)
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
