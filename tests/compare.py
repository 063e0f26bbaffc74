"""Both engines' results as sorted rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def engine(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def value(column: str, v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if column in ("day", "imported"):
        return str(v)[:10]
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(df: pd.DataFrame) -> list[str]:
    columns = sorted(df.columns)
    return sorted(repr([value(c, v) for c, v in zip(columns, r, strict=True)]) for r in df[columns].astype(object).itertuples(index=False, name=None))
