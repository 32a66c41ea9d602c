"""Spark-vs-DuckDB result comparison (rows, column names, order-insensitive values)."""

from __future__ import annotations

import datetime
import math

import duckdb
import pandas as pd

from ledgerline.sources.tables import TABLES


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, approx: bool):
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, datetime.datetime) and v.time() == datetime.time(0) and v.tzinfo is None:
        return ("d", v.date())
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return ("d", v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if approx:
            return float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, approx) for x in v)
    return v


def rows(pdf: pd.DataFrame, approx: bool = False) -> list[tuple]:
    cols = sorted(pdf.columns)
    recs = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
    return sorted((tuple(_norm(r[c], approx) for c in cols) for r in recs), key=repr)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return False, f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return False, f"row counts differ: {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = rows(spark_pdf), rows(duck_pdf)
    if a == b:
        return True, "exact"
    a, b = rows(spark_pdf, True), rows(duck_pdf, True)
    sb = set(b)
    diff = [r for r in a if r not in sb][:3]
    return False, f"values differ{' beyond 9 digits' if a != b else ' in last digits'}: {diff}"
