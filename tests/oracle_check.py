"""Run the catalogue against its SQL counterparts in DuckDB.

    python tests/oracle_check.py [scale] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from devicelog.plans import catalog, oracle  # noqa: E402
from devicelog.session import build_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{name}'")
    return con


def as_text(frame: pd.DataFrame) -> pd.DataFrame:
    """Sorted columns, every value as text, rows in a common order."""

    def text(value) -> str:
        if value is None or (not isinstance(value, (list, tuple)) and pd.isna(value)):
            return "∅"
        if isinstance(value, bool) or str(value) in ("True", "False"):
            return str(bool(value))
        if isinstance(value, (int, float)) or hasattr(value, "dtype"):
            return f"{float(value) + 0.0:.9g}" if not isinstance(value, pd.Timestamp) else str(value)
        return str(value)

    frame = frame[sorted(frame.columns)]
    out = pd.DataFrame({c: [text(v) for v in frame[c].astype(object)] for c in frame.columns})
    return out.sort_values(list(out.columns), ignore_index=True)


def difference(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(duck_frame.columns)}"
    if len(spark_frame) != len(duck_frame):
        return f"rows {len(spark_frame)} / {len(duck_frame)}"
    a, b = as_text(spark_frame), as_text(duck_frame)
    wrong = (a != b).any(axis=1)
    if wrong.any():
        i = wrong.idxmax()
        bad = [c for c in a.columns if a.at[i, c] != b.at[i, c]]
        return f"{wrong.sum()} rows differ, first: " + ", ".join(
            f"{c}: {a.at[i, c]} / {b.at[i, c]}" for c in bad[:4]
        )
    return None


def main() -> int:
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{scale}"
    queries, sql = catalog.queries(), oracle.oracle_sql()
    chosen = sys.argv[2:] or list(queries)
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failures = 0
    for name in chosen:
        start = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            took = time.time() - start
            if name in sql:
                problem = difference(got, con.execute(sql[name]).df())
            else:
                problem = None if len(got) else "no rows"
        except Exception as error:  # noqa: BLE001
            took, got, problem = time.time() - start, [], f"{type(error).__name__}: {str(error)[:700]}"
        failures += problem is not None
        kind = "sql " if name in sql else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {name:28} {len(got):8} rows {took:6.2f}s {problem or ''}", flush=True)
    print(f"{len(chosen) - failures} of {len(chosen)} ok")
    return failures


if __name__ == "__main__":
    sys.exit(main())
