"""Runs a query and its DuckDB statement over one folder and compares names, rows and values."""

from __future__ import annotations

import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _plain(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return bool(v)
    if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "float", "Decimal")):
        return round(float(v), 9)
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray" else str(v)


def rows(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr([_plain(v) for v in r]) for r in frame.astype(object).itertuples(index=False, name=None))
