"""Run registered queries against their SQL on DuckDB and report differences."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _canon(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pdf[c].dtype.kind in "iufb" or pd.api.types.is_numeric_dtype(pdf[c]):
            pdf[c] = pdf[c].astype("float64")
        else:
            pdf[c] = pdf[c].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v))
    return pdf.sort_values(list(pdf.columns), na_position="first", kind="stable").reset_index(drop=True)


def differences(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str:
    """Empty when both hold the same rows; exact except for the summation order of doubles."""
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(sql_pdf.columns)}"
    if len(spark_pdf) != len(sql_pdf):
        return f"{len(spark_pdf)} rows vs {len(sql_pdf)}"
    a, b = _canon(spark_pdf), _canon(sql_pdf)
    for c in a.columns:
        if a[c].dtype.kind == "f" and b[c].dtype.kind == "f":
            x, y = a[c].to_numpy(), b[c].to_numpy()
            same = (x == y) | (np.isnan(x) & np.isnan(y))
        else:
            x, y = a[c].fillna("\0").astype(str).to_numpy(), b[c].fillna("\0").astype(str).to_numpy()
            same = x == y
        if not same.all():
            i = int(np.flatnonzero(~same)[0])
            return f"{c}: {(~same).sum()} differ, first {a.iloc[i].to_dict()} vs {b.iloc[i].to_dict()}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from tracelathe.session import build_session
    spark = build_session(master="local[8]", shuffle_partitions=8,
                          **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                             "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        t = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - t
            t = time.time()
            diff = differences(got, con.execute(sql[name]).df()) if name in sql else "(no SQL)"
            print(f"{name:24s} {len(got):7d} rows {took:6.2f}s sql {time.time() - t:5.2f}s {diff[:600]}", flush=True)
            bad += diff not in ("", "(no SQL)")
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"{name:24s} FAILED {type(e).__name__} {str(e)[:700]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
