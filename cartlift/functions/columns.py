"""Schema-level helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType, T.BooleanType)


def nan_to_null(col: Column | str) -> Column:
    """Float NaN becomes NULL (pandas/DuckDB treat NaN as missing)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c), c)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric (including boolean 0/1) columns in schema order."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def round_floats(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column (cross-engine comparison at 6 dp)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
