"""Column-level helpers (JVM-side expressions) and driver-side scalar maths."""

from cartlift.functions.columns import nan_to_null, numeric_columns, round_floats
from cartlift.functions.dates import floor_days, month_diff, month_start
from cartlift.functions.hashing import keyed_uniform

__all__ = ["nan_to_null", "numeric_columns", "round_floats", "floor_days", "month_diff",
           "month_start", "keyed_uniform"]
