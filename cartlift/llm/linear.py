"""Shared pieces of the trained text scorers: bounded samples of labelled
rows, Adam for small dense problems, and the logistic function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def hash_sample(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most ``n`` ids, those of lowest hash: a bounded sample that depends on
    neither the partitions nor the row order."""
    return (rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
            .orderBy(F.xxhash64("id"), "id").limit(n))


def adam(grad: Callable[[np.ndarray], np.ndarray], w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Full-batch Adam; ``grad`` gives the gradient at a point."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = grad(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w
