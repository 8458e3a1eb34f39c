"""Date arithmetic with the semantics the analytics need.

Elapsed days are *floored* elapsed time (-1 hour is -1 day), not calendar
boundaries: ``datediff`` counts midnights and ``timestampdiff(DAY)``
truncates toward zero, both wrong here.  Differences are taken as NTZ
intervals, which do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MICROS_PER_DAY = 86_400_000_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def elapsed_micros(later: Column | str, earlier: Column | str) -> Column:
    """Microseconds from ``earlier`` to ``later`` (TIMESTAMP_NTZ), zone-free.

    NTZ - NTZ is a DAY TO SECOND interval; its fields are summed exactly.
    (``timestamp_diff`` on NTZ goes through the session zone at run time, so a
    wall-clock time inside a daylight-saving gap is moved by an hour.)
    """
    iv = _c(later) - _c(earlier)
    return (F.extract(F.lit("DAY"), iv).cast("long") * 86_400_000_000
            + F.extract(F.lit("HOUR"), iv).cast("long") * 3_600_000_000
            + F.extract(F.lit("MINUTE"), iv).cast("long") * 60_000_000
            + (F.extract(F.lit("SECOND"), iv) * 1_000_000).cast("long"))


def floor_days(later: Column | str, earlier: Column | str) -> Column:
    """floor((later - earlier) / 1 day) as bigint; NULL if either is NULL."""
    return F.floor(elapsed_micros(later, earlier) / F.lit(float(_MICROS_PER_DAY))).cast("bigint")


def month_start(ts: Column | str) -> Column:
    """First day of the month, as DATE (zone-free for NTZ input)."""
    return F.trunc(F.to_date(_c(ts)), "month")


def month_diff(start_month: Column | str, end_month: Column | str) -> Column:
    """Whole months between two month starts: (y2-y1)*12 + m2-m1, as int."""
    s, e = _c(start_month), _c(end_month)
    return ((F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)).cast("int")
