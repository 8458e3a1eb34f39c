"""Scalars read from one-row aggregates and turned into literals.

A reference time, a cutoff or a total is one value: it is read on the
driver from a one-row aggregate (a bounded read) and attached as a literal,
so no join is needed to carry it onto every row.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_value(df: DataFrame, col: str | None = None):
    """The single value of a one-row frame (None for an empty frame)."""
    row = df.first()
    if row is None:
        return None
    return row[col] if col else row[0]


def side_by_side(calls: Sequence[Callable], most: int = 6) -> list:
    """Results of independent readouts whose Spark jobs run at the same time."""
    with ThreadPoolExecutor(max_workers=max(1, min(most, len(calls)))) as pool:
        return [f.result() for f in [pool.submit(c) for c in calls]]


def double_lit(v) -> Column:
    return F.lit(None if v is None else float(v)).cast("double")


def ntz_lit(v: _dt.datetime | None) -> Column:
    """TIMESTAMP_NTZ literal, independent of session and process time zones."""
    if v is None:
        return F.lit(None).cast("timestamp_ntz")
    return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
