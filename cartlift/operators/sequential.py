"""Sample-ratio check under continual looks (E-2).

A chi-square test of each day's users, repeated every day, alarms sooner or
later in a sound experiment.  Here the test is one running bet against the
planned ratio r: with S = treated - r n over the first n distinct users,

    E = (1 + n v / 4)^(-1/2) * exp(v S^2 / (2 (1 + n v / 4)))

is the mixture of exp(l S - l^2 n / 8) over l ~ N(0, v).  An arm is a bounded
draw, so each of these has expectation at most 1 under the plan whatever r is,
and so has E at any time one likes to look.  Hence the chance that E ever
reaches 1 / alpha is at most alpha, over all looks together; 1 / (largest E so
far) is a p-value that holds at every look.  ``v = 4 / tuned_for`` makes the
test most alert after about ``tuned_for`` users.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlift.sources.raw import ARM


def first_windows(users: DataFrame, user: str = "user_id") -> DataFrame:
    """(window_start, n_treat, n_control): each user counts once, in its first
    window; combined map-side, so a busy user costs one row per task."""
    first = users.groupBy(user, ARM).agg(F.min("window_start").alias("window_start"))
    return arm_counts(first)


def arm_counts(users: DataFrame) -> DataFrame:
    return users.groupBy("window_start").agg(F.sum((F.col(ARM) == 1).cast("long")).alias("n_treat"),
                                             F.sum((F.col(ARM) == 0).cast("long")).alias("n_control"))


def running_srm(counts: DataFrame, ratio: float = 0.5, alpha: float = 0.001, tuned_for: float = 1000.0,
                group_cols: Sequence[str] = ()) -> DataFrame:
    """Running test over windows: cumulative users, log E, p-value valid at every
    look, and ``srm_ok`` (no alarm so far).  ``counts`` has a row per window, or
    several that add up; windows of one group are few and meet in one task."""
    keys = list(group_cols)
    w = Window.partitionBy(*keys).orderBy("window_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = counts.groupBy(*keys, "window_start").agg(F.sum("n_treat").alias("new_treat"), F.sum("n_control").alias("new_control"))
    cum = per.select(*keys, "window_start", F.sum("new_treat").over(w).alias("n_treat"), F.sum("new_control").over(w).alias("n_control"))
    n = (F.col("n_treat") + F.col("n_control")).cast("double")
    s = F.col("n_treat") - F.lit(ratio) * n
    v = 4.0 / tuned_for
    grown = 1 + n * (v / 4)
    log_e = -F.log(grown) / 2 + v * s * s / (2 * grown)
    seen = cum.withColumn("log_e", log_e).withColumn("_top", F.max("log_e").over(w))
    return seen.select(*keys, "window_start", "n_treat", "n_control", "log_e",
                       F.least(F.lit(1.0), F.exp(-F.col("_top"))).alias("p_value"),
                       (F.col("_top") < F.lit(-math.log(alpha))).alias("srm_ok"))
