"""Order-insensitive comparison of a query result with DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import numpy as np
import pandas as pd

from panelloom.sources.tables import NAMES


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def kind(value) -> str:
    if isinstance(value, (bool, np.bool_)):
        return "bool"
    if isinstance(value, (int, np.integer)):
        return "int"
    if isinstance(value, (float, np.floating)):
        return "float"
    return type(value).__name__


def plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, (float, np.floating)):
        return None if math.isnan(value) else float(value) + 0.0
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, np.integer):
        return int(value)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (pd.Timestamp, dt.datetime)):
        stamp = pd.Timestamp(value)
        return str(stamp.date()) if stamp == stamp.normalize() else str(stamp)
    if isinstance(value, dt.date):
        return str(value)
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    out = [tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)]
    return sorted(out, key=repr)


def compare(got: pd.DataFrame, con, sql: str) -> str | None:
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = [
        (c, str(got[c].dtype), str(want[c].dtype))
        for c in got.columns
        if got[c].dtype.kind != want[c].dtype.kind and not {got[c].dtype.kind, want[c].dtype.kind} <= set("OM")
    ]
    if kinds:
        return f"types differ: {kinds}"
    left, right = rows(got), rows(want)
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        return f"{len(different)} of {len(left)} rows differ, first: {different[:2]}"
    return None
