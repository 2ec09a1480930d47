"""Spark query against DuckDB oracle on the same tables."""

from __future__ import annotations

import glob
import math
import os


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {name} as select * from read_parquet('{source}')")
    return con


def _key(row):
    return tuple((v is None or v != v, "" if v is None or v != v else (f"{v:.4f}" if isinstance(v, float) else str(v))) for v in row)


def difference(spark_df, con, sql: str) -> str:
    """Empty if both have the same columns and rows; doubles may differ by 1.5 units of their last kept digit."""
    got = spark_df.toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    names = sorted(got.columns)
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    rows = [sorted(df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None), key=_key) for df in (got, want)]
    for a, b in zip(*rows):
        for n, x, y in zip(names, a, b):
            same = math.isclose(x, y, rel_tol=1e-9, abs_tol=1.5e-6) if isinstance(x, float) and isinstance(y, (float, int)) else str(x) == str(y)
            if not same:
                return f"{n}: {x!r} and {y!r} in {a} and {b}"
    return ""
