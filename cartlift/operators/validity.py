"""Experiment design and validity checks (O-28..O-35).

Every readout is one aggregate over the customer table (conditional
aggregates by arm), so it costs one scan and a few-row shuffle; the
power constants are solved once on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlift.functions.stats import chi2_df1_critical, power_delta
from cartlift.sources.raw import ARM, OUTCOME


def recent_flag(window_days: int, recency: str = "recency_days") -> Column:
    """Bought within the window before the reference time; missing = not (O-28/O-40)."""
    return F.coalesce(F.col(recency) <= F.lit(window_days), F.lit(False)).cast("double")


def _arm(v: int) -> Column:
    return F.col(ARM) == F.lit(v)


def experiment_design(features: DataFrame, window_days: int = 7, mde: float = 0.01,
                      alpha: float = 0.05, power: float = 0.80,
                      by: Sequence[str] = ()) -> DataFrame:
    """Pre-period base rate, Cohen's h, required n per arm and the MDE reachable
    with the actual n (O-28..O-30), overall or per group ``by``.

    h = 2 asin sqrt(p + mde) - 2 asin sqrt(p); n = 2 (delta / h)^2;
    achievable h = delta sqrt(2 / n); MDE = sin^2((2 asin sqrt p + h) / 2) - p.
    """
    delta = F.lit(power_delta(alpha, power))
    g = features.groupBy(*by) if by else features.groupBy()
    agg = g.agg(F.avg(recent_flag(window_days)).alias("base_rate"),
                F.sum(F.when(_arm(1), 1).otherwise(0)).cast("bigint").alias("n_treat"),
                F.sum(F.when(_arm(0), 1).otherwise(0)).cast("bigint").alias("n_control"))
    p = F.col("base_rate")
    phi0 = F.lit(2.0) * F.asin(F.sqrt(p))
    h = F.lit(2.0) * F.asin(F.sqrt(p + F.lit(mde))) - phi0
    n = F.least("n_treat", "n_control")
    ach_h = delta * F.sqrt(F.try_divide(F.lit(2.0), n.cast("double")))
    ach = F.pow(F.sin((phi0 + ach_h) / 2), 2) - p
    return agg.select(*by, "base_rate", F.lit(mde).alias("mde"), h.alias("cohen_h"),
                      (F.lit(2.0) * F.pow(F.try_divide(delta, h), 2)).alias("required_n_per_arm"),
                      "n_treat", "n_control", n.alias("n_per_arm"),
                      ach_h.alias("achievable_h"), ach.alias("achievable_mde"),
                      (ach * 100).alias("achievable_mde_pp"))


def split_counts(df: DataFrame) -> DataFrame:
    """Customers and share per arm (O-31)."""
    counts = df.groupBy(ARM).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over one row per arm
    return counts.select(ARM, "n", (F.col("n") / total).alias("share"))


def srm(df: DataFrame, ratio: float = 0.5, alpha: float = 0.001) -> DataFrame:
    """Sample-ratio mismatch chi-square against the design ratio (O-32).

    ``srm_ok`` is p > alpha, i.e. chi2 below the df-1 critical value; the
    p-value itself is in :func:`srm_test`.
    """
    agg = df.agg(F.sum(F.when(_arm(1), 1).otherwise(0)).cast("bigint").alias("n_treat"),
                 F.sum(F.when(_arm(0), 1).otherwise(0)).cast("bigint").alias("n_control"))
    n = F.col("n_treat") + F.col("n_control")
    et, ec = n * F.lit(ratio), n * F.lit(1.0 - ratio)
    chi2 = (F.pow(F.col("n_treat") - et, 2) / et) + (F.pow(F.col("n_control") - ec, 2) / ec)
    return agg.select("n_treat", "n_control", et.alias("expected_treat"), ec.alias("expected_control"),
                      chi2.alias("chi2"), (chi2 < F.lit(chi2_df1_critical(alpha))).alias("srm_ok"))


def srm_test(df: DataFrame, ratio: float = 0.5, alpha: float = 0.001) -> DataFrame:
    """:func:`srm` plus its p-value, erfc(sqrt(chi2 / 2)) at one degree of freedom."""
    from cartlift.functions.stats import p_value_col
    s = srm(df, ratio, alpha)
    return s.withColumn("p_value", p_value_col(F.sqrt(F.col("chi2"))))


def long_features(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot numeric columns to (``keep``..., feature, feature_pos, value)."""
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("feature_pos"), F.col(c).cast("double").alias("value"))
        for i, c in enumerate(cols)])).alias("_r")).select(*keep, "_r.feature", "_r.feature_pos", "_r.value")


def covariate_balance(df: DataFrame, feature_cols: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """Standardised mean difference per numeric feature (O-33).

    Long form: the features are unpivoted and one group-by on the feature
    computes mean and sample variance per arm (NULLs skipped per feature);
    partial aggregation keeps the shuffle at one row per feature and task.
    (A single 92-aggregate row would exceed the whole-stage codegen field
    limit and run interpreted.)  Features with zero or undefined pooled SD
    are left out.
    """
    x = F.col("value")
    long = long_features(df, feature_cols, keep=[ARM])
    agg = long.groupBy("feature", "feature_pos").agg(
        F.avg(F.when(_arm(1), x)).alias("mean_treat"), F.avg(F.when(_arm(0), x)).alias("mean_control"),
        F.var_samp(F.when(_arm(1), x)).alias("vt"), F.var_samp(F.when(_arm(0), x)).alias("vc"))
    sd = F.sqrt((F.col("vt") + F.col("vc")) / 2)
    smd = (F.col("mean_treat") - F.col("mean_control")) / F.col("sd_pooled")
    return (agg.withColumn("sd_pooled", sd).where(F.col("sd_pooled") > 0)
            .select("feature", "feature_pos", "mean_treat", "mean_control", "sd_pooled",
                    smd.alias("smd"), F.abs(smd).alias("abs_smd"),
                    (F.abs(smd) >= F.lit(threshold)).alias("imbalanced")))


def worst_balance(balance: DataFrame, k: int = 5) -> DataFrame:
    """Top-k features by |SMD|, ties by feature position (O-34)."""
    return balance.orderBy(F.col("abs_smd").desc(), F.col("feature_pos")).limit(k)


def arm_rates(df: DataFrame) -> DataFrame:
    """Outcome rate per arm and raw difference (O-35)."""
    y = F.col(OUTCOME).cast("double")
    return (df.agg(F.avg(F.when(_arm(0), y)).alias("rate_control"),
                   F.avg(F.when(_arm(1), y)).alias("rate_treat"))
            .withColumn("diff", F.col("rate_treat") - F.col("rate_control")))
