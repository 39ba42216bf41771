"""Run registered queries next to their SQL in DuckDB and compare value by value.

``python tests/oracle_compare.py [name ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({c: pdf[c] for c in sorted(pdf.columns)})
    for c in out.columns:
        s = out[c]
        if str(s.dtype).startswith("datetime") or (s.dtype == object and len(s.dropna()) and isinstance(s.dropna().iloc[0], pd.Timestamp)):
            out[c] = pd.to_datetime(s).astype("datetime64[us]").astype(str)
        elif s.dtype == object:
            out[c] = s.map(lambda v: list(v) if isinstance(v, np.ndarray) else v).map(
                lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v))
        elif pd.api.types.is_bool_dtype(s):
            out[c] = s.map(str)
        else:
            out[c] = pd.to_numeric(s).astype(float)
    key = [out[c].map(lambda v: (v is None or v != v, str(v))) for c in out.columns]
    order = sorted(range(len(out)), key=lambda i: tuple(k.iloc[i] for k in key))
    return out.iloc[order].reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same[~same].index[0]
            return f"{c}: {(~same).sum()} of {len(a)} differ, e.g. {a[c][i]!r} vs {b[c][i]!r}"
    return None


def main(names: list[str], sf: str = "/root/testdata/sf0.01") -> int:
    from candlewick.session import build_session
    from __spark_entry__ import oracle_sql, queries
    spark = build_session("oracle", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sql = queries(), oracle_sql()
    con, bad = duck(sf), 0
    for n in names or list(qs):
        t0 = time.time()
        try:
            got = qs[n](spark, sf).toPandas()
            t1 = time.time()
            diff = difference(got, con.execute(sql[n]).df()) if n in sql else None
            state = "ok" if diff is None and n in sql else ("rows" if n not in sql else "DIFF " + diff)
        except Exception as e:  # report and go on to the next query
            t1, state = time.time(), "ERR " + str(e)[:600]
            got = ()
        bad += state.startswith(("DIFF", "ERR"))
        print(f"{n:28s} {len(got):7d} rows {t1 - t0:6.2f}s sql {time.time() - t1:6.2f}s {state}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
