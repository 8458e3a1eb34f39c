"""Regression adjustment: OLS with HC1 robust errors in distributed passes
(O-43..O-46).

Passes over the customer table, each a single aggregate (partial sums
map-side, one tiny shuffle):

0. medians of columns that contain NULLs (exact and distributed, see
   :func:`cartlift.operators.ranking.exact_quantiles`) for imputation;
1. mean and SD of every imputed column (for standardisation: amounts run to
   1e6 while dummies are 0/1, and the Gram matrix squares the conditioning);
2. Gram matrix Z'Z and Z'y of the standardised design;
3. the HC1 meat  sum e_i^2 z_i z_i'  with the fitted coefficients.

Passes 2 and 3 fold Arrow batches into one k-by-k numpy partial per
partition (``mapInPandas``) and sum the partials with a small group-by; a
k(k+1)/2-wide SQL aggregate would compile to a very large generated method.

Only k-by-k matrices reach the driver.  The solve uses an eigen
decomposition with a relative cut-off, so constant or collinear columns
(an all-zero dummy) reduce the rank instead of failing; the HC1 factor uses
n / (n - rank).  Coefficients are mapped back to original units.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlift.functions.stats import norm_ppf, two_sided_p
from cartlift.operators.ranking import exact_quantiles


EIGEN_RCOND = 1e-11


@dataclass
class OLSResult:
    terms: list[str]
    coef: list[float | None]
    se: list[float | None]
    n: int
    rank: int

    def row(self, term: str) -> tuple[float | None, float | None]:
        i = self.terms.index(term)
        return self.coef[i], self.se[i]

    def to_frame(self, spark, z: float | None = None) -> DataFrame:
        z = z or norm_ppf(0.975)
        rows = []
        for t, b, s in zip(self.terms, self.coef, self.se):
            zz = (b / s) if (b is not None and s not in (None, 0.0)) else None
            rows.append((t, b, s, zz, two_sided_p(zz) if zz is not None else None,
                         None if b is None or s is None else b - z * s,
                         None if b is None or s is None else b + z * s))
        return spark.createDataFrame(
            rows, "term string, coef double, se double, z double, p_value double, ci_lo double, ci_hi double")


def column_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    """Per column: rows, NULLs, mean and SD of the non-NULL values (one long-form pass)."""
    from cartlift.operators.validity import long_features
    long = long_features(df, cols)
    rows = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").isNull().cast("long")).alias("nulls"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).collect()  # one row per column
    return {r["feature"]: r.asDict() for r in rows}


def impute_medians(df: DataFrame, cols: Sequence[str],
                   approximate: bool = False, moments: dict[str, dict] | None = None,
                   **rank_kw) -> dict[str, float | None]:
    """Median of every column that has NULLs (others need no fill value).

    Exact by default (see :func:`exact_quantiles`).
    ``approximate=True`` uses ``percentile_approx`` sketches instead.
    """
    from cartlift.operators.validity import long_features
    moments = moments or column_moments(df, cols)
    need = [c for c in cols if moments[c]["nulls"]]
    if not need:
        return {}
    if approximate:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 100000).alias(c)
                       for c in need]).first().asDict()
        return {c: row[c] for c in need}
    long = long_features(df, need).drop("feature_pos")
    med = exact_quantiles(long, "value", [0.5], group_cols=["feature"], **rank_kw)
    got = {r["feature"]: r["value"] for r in med.collect()}  # one row per column
    return {c: got.get(c) for c in need}


def _cross_products(df: DataFrame, z_cols: list, y_col, beta: np.ndarray | None = None
                    ) -> tuple[np.ndarray, np.ndarray]:
    """Sum over rows of z z' (and z y), or of e^2 z z' when ``beta`` is given.

    ``z_cols`` excludes the intercept, which is added in numpy.  Each
    partition folds its Arrow batches into one k-by-k partial (BLAS), emits it
    as (position, value) rows, and a small group-by sums the partials, so the
    driver receives only k^2 + k numbers.
    """
    k = len(z_cols) + 1
    proj = df.select(*[c.alias(f"z{i}") for i, c in enumerate(z_cols)], y_col.alias("y"))
    names = [f"z{i}" for i in range(k - 1)]
    b = None if beta is None else np.asarray(beta, dtype=float)

    def fold(batches):
        G = np.zeros((k, k))
        v = np.zeros(k)
        for pdf in batches:
            Z = np.empty((len(pdf), k))
            Z[:, 0] = 1.0
            if names:
                Z[:, 1:] = pdf[names].to_numpy(dtype=float)
            yy = pdf["y"].to_numpy(dtype=float)
            if b is None:
                G += Z.T @ Z
                v += Z.T @ yy
            else:
                e = yy - Z @ b
                G += (Z * (e * e)[:, None]).T @ Z
        yield pd.DataFrame({"pos": np.arange(k * k + k, dtype=np.int32), "v": np.concatenate([G.ravel(), v])})

    parts = proj.mapInPandas(fold, "pos int, v double")
    got = dict((r["pos"], r["v"]) for r in parts.groupBy("pos").agg(F.sum("v").alias("v")).collect())
    flat = np.array([got.get(i, 0.0) for i in range(k * k + k)])
    return flat[:k * k].reshape(k, k), flat[k * k:]


def ols_hc1(df: DataFrame, y: str, x_cols: Sequence[str], fill: dict[str, float | None] | None = None,
            moments: dict[str, dict] | None = None) -> OLSResult:
    """OLS of ``y`` on an intercept and ``x_cols`` with HC1 covariance."""
    fill = fill or {}
    xs = {}
    for c in x_cols:
        col = F.col(c).cast("double")
        if fill.get(c) is not None:
            col = F.coalesce(col, F.lit(float(fill[c])))
        xs[c] = col
    yy = F.col(y).cast("double")
    # pass 1: per-column moments of the observed values set the standardisation
    # (any centre and positive scale give the same fit; results are mapped back)
    mom = moments or column_moments(df, list(x_cols))
    names = list(xs)
    n = int(next(iter(mom.values()))["n"]) if mom else df.count()
    means = [mom[c]["mean"] for c in names]
    sds = [mom[c]["sd"] for c in names]
    # a column is live if it varies among observed values (imputing the
    # median cannot make a constant column vary)
    live = [i for i in range(len(names)) if sds[i] is not None and sds[i] > 0 and means[i] is not None
            and (fill.get(names[i]) is not None or not mom[names[i]]["nulls"])]
    z = [(xs[names[i]] - F.lit(means[i])) / F.lit(sds[i]) for i in live]
    k = len(z) + 1
    # pass 2: Gram matrix and cross-products of the standardised design
    G, zy = _cross_products(df, z, yy)
    w, V = np.linalg.eigh(G)
    # Gram eigenvalues carry ~eps * w_max absolute error, so the cut-off is
    # relative on eigenvalues (condition number 1e11 of the standardised Gram)
    wmax = max(w.max(), 0.0)
    keep = w > wmax * EIGEN_RCOND
    rank = int(keep.sum())
    Ginv = (V[:, keep] / w[keep]) @ V[:, keep].T
    beta = Ginv @ zy
    # pass 3: HC1 meat from residuals of the fitted coefficients
    M, _ = _cross_products(df, z, yy, beta)
    cov = Ginv @ M @ Ginv * (n / (n - rank) if n > rank else float("nan"))
    # back to original units: beta = T beta_std
    T = np.zeros((k, k))
    T[0, 0] = 1.0
    for pos, i in enumerate(live, start=1):
        T[pos, pos] = 1.0 / sds[i]
        T[0, pos] = -means[i] / sds[i]
    b_orig = T @ beta
    cov_orig = T @ cov @ T.T
    coef: list[float | None] = [None] * (len(names) + 1)
    se: list[float | None] = [None] * (len(names) + 1)
    coef[0], se[0] = float(b_orig[0]), float(math.sqrt(max(cov_orig[0, 0], 0.0)))
    for pos, i in enumerate(live, start=1):
        coef[i + 1] = float(b_orig[pos])
        se[i + 1] = float(math.sqrt(max(cov_orig[pos, pos], 0.0)))
    return OLSResult(["intercept", *names], coef, se, n, rank)
