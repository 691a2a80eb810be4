"""Run registered queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def mismatch(spark_df, con, sql: str) -> str | None:
    """A description of the first difference, or None when the results are equal."""
    got_cols, got = _sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want_cols, want = _sorted_rows(names, result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; {got[:2]} / {want[:2]}"
    types = {type(v) for row in want for v in row}
    for mine, theirs in zip(got, want):
        if mine != theirs or [type(v) for v in mine] != [type(v) for v in theirs]:
            return f"{got_cols}\n   spark {mine}\n   sql   {theirs}"
    if any("Decimal" in t.__name__ for t in types):
        return "decimal in SQL result"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tracewell.cluster import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session("8")
    con = connect(sf_dir)
    sql = oracle_sql()
    failures = 0
    for name, run in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sql:
                problem = mismatch(df, con, sql[name])
                n = -1
            else:
                n = df.count()
                problem = None if n else "no rows"
        except Exception:  # noqa: BLE001
            problem = traceback.format_exc()[-1500:]
        failures += problem is not None
        state = "ok  " if problem is None else "FAIL"
        kind = "sql" if name in sql else f"rows-only {n}"
        print(f"{state} {name} {time.time() - started:.1f}s {kind} {problem or ''}", flush=True)
    print(f"{failures} failures")
    return 1 if failures else 0


if __name__ == "__main__":
    raise SystemExit(main())
