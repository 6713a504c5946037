"""Compare a query with its SQL on the driver's tables, as the driver does: columns by name, rows as a multiset."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    return con


def rows(table: pd.DataFrame) -> Counter:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool):
            return v
        if hasattr(v, "isoformat"):
            return str(v)[:10]
        if isinstance(v, (int, float)) or hasattr(v, "item"):
            return round(float(v), 6)
        return str(v)

    return Counter(tuple(plain(v) for v in r) for r in table[sorted(table.columns)].itertuples(index=False, name=None))


def difference(mine, theirs) -> str:
    """Empty if equal; else what differs."""
    a, b = mine.toPandas(), theirs
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    x, y = rows(a.astype(object)), rows(b.astype(object))
    if x == y:
        return ""
    return f"{sum(x.values())} and {sum(y.values())} rows; only here {list((x - y).items())[:3]}; only there {list((y - x).items())[:3]}"
