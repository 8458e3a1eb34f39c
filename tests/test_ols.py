import numpy as np
import pandas as pd

from cartlift.operators import ols


def _hc1_numpy(X, y):
    """Direct OLS with HC1 errors (pseudo-inverse; rank from singular values)."""
    n = len(y)
    XtX_inv = np.linalg.pinv(X.T @ X)
    beta = XtX_inv @ X.T @ y
    e = y - X @ beta
    rank = np.linalg.matrix_rank(X)
    meat = (X * (e * e)[:, None]).T @ X
    cov = XtX_inv @ meat @ XtX_inv * n / (n - rank)
    return beta, np.sqrt(np.diag(cov)), rank


def test_ols_hc1_matches_numpy(spark):
    rng = np.random.default_rng(7)
    n = 600
    arm = rng.integers(0, 2, n)
    x1 = rng.normal(50, 20, n)
    x2 = rng.normal(2e6, 5e5, n)          # large scale
    x3 = rng.integers(0, 2, n)             # dummy
    x1_obs = x1.copy()
    x1_obs[rng.random(n) < 0.1] = np.nan   # missing -> median
    const = np.zeros(n)                    # all-zero dummy (rank deficient)
    y = (rng.random(n) < 0.4 + 0.05 * arm + 0.002 * (x1 - 50)).astype(float)
    pdf = pd.DataFrame({"client_id": np.arange(n), "target": y, "treatment_flg": arm, "x1": x1_obs,
                        "x2": x2, "x3": x3, "zero": const})
    df = spark.createDataFrame(pdf.astype({"x1": "float64"})).repartition(5)
    cols = ["treatment_flg", "x1", "x2", "x3", "zero"]
    mom = ols.column_moments(df, cols)
    fill = ols.impute_medians(df, cols, moments=mom)
    assert abs(fill["x1"] - np.nanmedian(x1_obs)) < 1e-12
    res = ols.ols_hc1(df, "target", cols, fill, moments=mom)
    X = np.column_stack([np.ones(n), arm, np.where(np.isnan(x1_obs), np.nanmedian(x1_obs), x1_obs), x2, x3, const])
    beta, se, rank = _hc1_numpy(X, y)
    assert res.rank == rank == 5
    b, s = res.row("treatment_flg")
    assert abs(b - beta[1]) < 1e-9 * max(1, abs(beta[1]))
    assert abs(s - se[1]) / se[1] < 1e-7
    b2, s2 = res.row("x2")
    assert abs(b2 - beta[3]) / abs(beta[3]) < 1e-6 and abs(s2 - se[3]) / se[3] < 1e-6
    assert res.row("zero") == (None, None)


def test_ols_collinear_column(spark):
    rng = np.random.default_rng(11)
    n = 300
    arm = rng.integers(0, 2, n)
    x = rng.normal(size=n)
    y = (rng.random(n) < 0.5 + 0.1 * arm).astype(float)
    pdf = pd.DataFrame({"target": y, "treatment_flg": arm, "x": x, "x_copy": 2 * x + 1})
    df = spark.createDataFrame(pdf)
    res = ols.ols_hc1(df, "target", ["treatment_flg", "x", "x_copy"])
    X = np.column_stack([np.ones(n), arm, x, 2 * x + 1])
    beta, se, rank = _hc1_numpy(X, y)
    assert res.rank == rank == 3
    b, s = res.row("treatment_flg")
    assert abs(b - beta[1]) < 1e-8 and abs(s - se[1]) / se[1] < 1e-6
