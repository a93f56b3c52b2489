"""Run registered queries in Spark and in DuckDB and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from tidewatch.plans.views import BASE_TABLES  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark, con, folder: str, name: str, job, sql: str) -> tuple[bool, str]:
    df = job(spark, folder)
    cols = sorted(df.columns)
    got = Counter(tuple(_norm(v) for v in r) for r in df.select(*[df[f"`{c}`"] for c in cols]).collect())
    cur = con.execute(sql)
    sql_cols = [c[0] for c in cur.description]
    if sorted(sql_cols) != cols:
        return False, f"columns {cols} vs {sorted(sql_cols)}"
    at = [sql_cols.index(c) for c in cols]
    want = Counter(tuple(_norm(r[i]) for i in at) for r in cur.fetchall())
    if got == want:
        return True, f"{sum(got.values())} rows"
    missing, extra = list((want - got).items())[:2], list((got - want).items())[:2]
    return False, f"rows {sum(got.values())} vs {sum(want.values())}\n  cols {cols}\n  missing {missing}\n  extra {extra}"


def main(argv: list[str]) -> int:
    from tidewatch.session import build_session

    import __spark_entry__ as entry

    folder = argv[0] if argv else "/root/testdata/sf0.001"
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            if name in oracles:
                ok, note = compare(spark, con, folder, name, queries[name], oracles[name])
            else:
                ok, note = True, f"{queries[name](spark, folder).count()} rows (no sql)"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:350]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
