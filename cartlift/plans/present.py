"""Presentation of result tables for cross-engine comparison.

Floats are rounded to 6 decimals (distributed float sums differ from serial
ones in the last bits) and dates/timestamps are rendered as text without a
session-zone conversion (NTZ values are wall-clock times).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")  # zone-free
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = F.substring(c.cast("string"), 1, 19)  # zone-free, whole seconds
        elif isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)
