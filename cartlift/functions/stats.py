"""Scalar statistics evaluated on the driver (a handful of numbers per call)
plus a JVM-side p-value column.

Spark SQL has no ``erf``; p-values come from ``math.erfc`` on the driver
(scalars) or from commons-math3's ``Erf.erfc`` via ``reflect`` (columns).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def two_sided_p(z: float) -> float:
    """P(|Z| >= |z|) for a standard normal."""
    if z is None or (isinstance(z, float) and math.isnan(z)):
        return float("nan")
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_df1_sf(chi2: float) -> float:
    """Upper tail of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(chi2, 0.0) / 2.0))


def norm_ppf(p: float) -> float:
    """Inverse normal CDF by bisection on erfc (exact to ~1e-15)."""
    if not 0.0 < p < 1.0:
        raise ValueError("p must lie in (0, 1)")
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if norm_cdf(mid) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def power_delta(alpha: float = 0.05, power: float = 0.80) -> float:
    """delta solving Phi(delta - z) + Phi(-delta - z) = power, z = z_{1-alpha/2}.

    A two-sided two-sample normal test with n per arm and Cohen's h has
    delta = h * sqrt(n / 2), hence n = 2 (delta / h)^2 and h = delta sqrt(2 / n).
    """
    z = norm_ppf(1.0 - alpha / 2.0)
    lo, hi = 0.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if norm_cdf(mid - z) + norm_cdf(-mid - z) < power:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def chi2_df1_critical(alpha: float) -> float:
    """chi2 value whose df-1 upper tail equals alpha: z_{1-alpha/2}^2."""
    z = norm_ppf(1.0 - alpha / 2.0)
    return z * z


def erfc_col(x: Column) -> Column:
    """JVM-side erfc through the commons-math3 library bundled with Spark
    (``reflect``), so readout p-values need no Python worker."""
    return F.call_function("reflect", F.lit("org.apache.commons.math3.special.Erf"),
                           F.lit("erfc"), x.cast("double")).cast("double")


def p_value_col(z: Column | str) -> Column:
    """Two-sided normal p-value of a z column: erfc(|z| / sqrt 2)."""
    zc = F.col(z) if isinstance(z, str) else z
    return erfc_col(F.abs(zc) / F.lit(math.sqrt(2.0)))
