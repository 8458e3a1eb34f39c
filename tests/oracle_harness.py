"""Compare a Spark query with its DuckDB oracle (row count, schema, values)."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck_run(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    try:
        return con.execute(sql).df()
    finally:
        con.close()


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v)).lower()
    if isinstance(v, (int, float, np.integer, np.floating)):
        f = float(v)
        if np.isnan(f):
            return None
        return repr(round(f, 6) + 0.0)
    return str(v)


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object)
    df = df.apply(lambda s: s.map(_cell))
    key = df.astype(str).apply(lambda r: "|".join(r), axis=1)
    return df.iloc[np.argsort(key.to_numpy(), kind="stable")].reset_index(drop=True)


def compare(spark_df, sql: str, sf_dir: str) -> tuple[bool, str]:
    sp = spark_df.toPandas()
    dk = duck_run(sql, sf_dir)
    if sorted(sp.columns) != sorted(dk.columns):
        return False, f"columns differ: spark={sorted(sp.columns)} duck={sorted(dk.columns)}"
    if len(sp) != len(dk):
        return False, f"rows differ: spark={len(sp)} duck={len(dk)}"
    a, b = _norm(sp), _norm(dk)
    diff = []
    for c in a.columns:
        x, y = a[c].astype(str), b[c].astype(str)
        bad = (x != y)
        if bad.any():
            i = int(np.argmax(bad.to_numpy()))
            diff.append(f"{c}: {bad.sum()} rows, e.g. spark={a[c][i]!r} duck={b[c][i]!r}")
    return (not diff), "; ".join(diff) or "ok"
