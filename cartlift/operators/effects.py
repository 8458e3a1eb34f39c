"""Average effect, variance reduction, segment effects, guardrails, decision
(O-36..O-51).  Each estimator is a single conditional aggregate; only the
OLS fit (see :mod:`cartlift.operators.ols`) needs more passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlift.functions.stats import norm_ppf
from cartlift.operators.validity import recent_flag
from cartlift.sources.raw import ARM, OUTCOME

Z_05 = norm_ppf(0.975)


def _arm(v: int) -> Column:
    return F.col(ARM) == F.lit(v)


def _y() -> Column:
    return F.col(OUTCOME).cast("double")


def _arm_moments(y: Column) -> list[Column]:
    return [F.sum(F.when(_arm(1), 1).otherwise(0)).cast("bigint").alias("n_treat"),
            F.sum(F.when(_arm(0), 1).otherwise(0)).cast("bigint").alias("n_control"),
            F.avg(F.when(_arm(1), y)).alias("rate_treat"),
            F.avg(F.when(_arm(0), y)).alias("rate_control"),
            F.var_samp(F.when(_arm(1), y)).alias("var_treat"),
            F.var_samp(F.when(_arm(0), y)).alias("var_control")]


def _unpooled_se() -> Column:
    return F.sqrt(F.try_divide(F.col("var_treat"), F.col("n_treat").cast("double"))
                  + F.try_divide(F.col("var_control"), F.col("n_control").cast("double")))


def effect_moments(df: DataFrame, window_days: int | None = None) -> DataFrame:
    """One aggregate with every moment the average-effect readouts need.

    Per arm: n, successes, mean and sample variance of the outcome; with
    ``window_days``, also the CUPED covariate X (bought in the pre-period):
    pooled Cov(Y, X), Var(X), E[X] and per-arm mean, variance and covariance.
    :func:`ate_naive`, :func:`two_proportion_z` and :func:`ate_cuped` are
    projections of this single row, so a readout scans the table once.
    """
    y = _y()
    aggs = [*_arm_moments(y),
            F.sum(F.when(_arm(1), F.col(OUTCOME).cast("bigint"))).alias("x_treat"),
            F.sum(F.when(_arm(0), F.col(OUTCOME).cast("bigint"))).alias("x_control")]
    if window_days is not None:
        x = recent_flag(window_days)
        aggs += [F.covar_samp(y, x).alias("cov_all"), F.var_samp(x).alias("varx_all"), F.avg(x).alias("ex")]
        for arm, tag in ((1, "t"), (0, "c")):
            aggs += [F.avg(F.when(_arm(arm), x)).alias(f"mx_{tag}"),
                     F.var_samp(F.when(_arm(arm), x)).alias(f"vx_{tag}"),
                     F.covar_samp(F.when(_arm(arm), y), F.when(_arm(arm), x)).alias(f"cxy_{tag}")]
    return df.agg(*aggs)


def naive_from(m: DataFrame, z: float = 1.96) -> DataFrame:
    ate = F.col("rate_treat") - F.col("rate_control")
    return (m.select("n_treat", "n_control", "rate_treat", "rate_control", ate.alias("ate"),
                     _unpooled_se().alias("se"))
            .withColumn("ci_lo", F.col("ate") - F.lit(z) * F.col("se"))
            .withColumn("ci_hi", F.col("ate") + F.lit(z) * F.col("se")))


def ate_naive(df: DataFrame, z: float = 1.96) -> DataFrame:
    """Difference in rates with unpooled SE and a fixed-z 95% CI (O-36/O-37).

    ``rate_control`` is the control-arm baseline (the North-Star reading).
    """
    return naive_from(effect_moments(df), z)


def z_from(m: DataFrame, alpha: float = 0.05) -> DataFrame:
    nt, nc = F.col("n_treat").cast("double"), F.col("n_control").cast("double")
    pt, pc = F.try_divide(F.col("x_treat"), nt), F.try_divide(F.col("x_control"), nc)
    pool = F.try_divide(F.col("x_treat") + F.col("x_control"), nt + nc)
    se0 = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), nt) + F.try_divide(F.lit(1.0), nc)))
    zc = F.try_divide(pt - pc, se0)
    crit = norm_ppf(1 - alpha / 2)
    return m.select("x_treat", "x_control", "n_treat", "n_control", pool.alias("p_pool"),
                    zc.alias("z"), (F.abs(zc) > F.lit(crit)).alias("reject_h0"))


def two_proportion_z(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Pooled-variance two-proportion z-test, two-sided (O-38)."""
    return z_from(effect_moments(df), alpha)


def cuped_from(m: DataFrame) -> DataFrame:
    theta = F.coalesce(F.try_divide(F.col("cov_all"), F.col("varx_all")), F.lit(0.0))
    a = m.withColumn("theta", theta)
    th = F.col("theta")
    out = a.select(
        "theta", "n_treat", "n_control", _unpooled_se().alias("se_naive"),
        (F.col("rate_treat") - th * (F.col("mx_t") - F.col("ex"))).alias("mean_treat"),
        (F.col("rate_control") - th * (F.col("mx_c") - F.col("ex"))).alias("mean_control"),
        (F.col("var_treat") + th * th * F.col("vx_t") - 2 * th * F.col("cxy_t")).alias("var_treat"),
        (F.col("var_control") + th * th * F.col("vx_c") - 2 * th * F.col("cxy_c")).alias("var_control"))
    cse = _unpooled_se()
    return out.select(
        "theta", (F.col("mean_treat") - F.col("mean_control")).alias("cuped_ate"), cse.alias("cuped_se"),
        F.try_divide(F.col("mean_treat") - F.col("mean_control"), cse).alias("cuped_z"),
        (F.lit(1.0) - F.try_divide(cse, F.col("se_naive"))).alias("se_reduction"))


def ate_cuped(df: DataFrame, window_days: int = 7) -> DataFrame:
    """CUPED with X = bought in the pre-period window (O-40..O-42), one pass.

    theta = Cov(Y, X) / Var(X) pooled over both arms (0 when Var(X) = 0, which
    makes CUPED equal the naive estimate).  Per arm, with Y' = Y - theta (X - E[X]):
    mean Y' = mean Y - theta (mean X_arm - E[X]) and
    var Y' = var Y + theta^2 var X - 2 theta cov(Y, X), all sample moments.
    """
    return cuped_from(effect_moments(df, window_days))


def ate_by_group(df: DataFrame, by: str, groups: Sequence[str] | None = None,
                 z: float = 1.96, min_per_arm: int = 2) -> DataFrame:
    """Effect per group with CI (O-48); groups with fewer than ``min_per_arm``
    rows in either arm are left out."""
    src = df.where(F.col(by).isin(list(groups))) if groups is not None else df
    ate = F.col("rate_treat") - F.col("rate_control")
    return (src.groupBy(by).agg(*_arm_moments(_y()))
            .where((F.col("n_treat") >= min_per_arm) & (F.col("n_control") >= min_per_arm))
            .select(F.col(by).alias("segment"), (F.col("n_treat") + F.col("n_control")).alias("n"),
                    "n_treat", "n_control", ate.alias("ate"), _unpooled_se().alias("se"))
            .withColumn("ci_lo", F.col("ate") - F.lit(z) * F.col("se"))
            .withColumn("ci_hi", F.col("ate") + F.lit(z) * F.col("se")))


def guardrails(seg_effects: DataFrame, champ_incr_max: float = 0.35) -> DataFrame:
    """G1 do-no-harm and G2 champions' share of incremental purchases (O-49/O-50).

    G1 fails if any segment CI lies wholly below 0.  G2 passes iff the share
    sum(ate n | champions) / sum(ate n) is defined (total > 0) and <= the cap.
    """
    incr = F.col("ate") * F.col("n")
    a = seg_effects.agg(
        F.sum(F.when(F.col("ci_hi") < 0, 1).otherwise(0)).cast("bigint").alias("n_harmed"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("ci_hi") < 0, F.col("segment")))))
         .alias("harmed_segments"),
        F.coalesce(F.sum(incr), F.lit(0.0)).alias("total_incr"),
        F.coalesce(F.sum(F.when(F.col("segment") == "champions", incr)), F.lit(0.0)).alias("champions_incr"))
    share = F.when(F.col("total_incr") > 0, F.col("champions_incr") / F.col("total_incr"))
    return a.select(
        "n_harmed", "harmed_segments", (F.col("n_harmed") == 0).alias("g1_pass"), "total_incr",
        "champions_incr", share.alias("champions_incr_share"),
        F.coalesce(share <= F.lit(champ_incr_max), F.lit(False)).alias("g2_pass"))


def decision(primary_pass: Column, g1: Column, g2: Column) -> Column:
    """LAUNCH iff the primary check and both guardrails pass (O-51)."""
    return F.when(primary_pass & g1 & g2, F.lit("LAUNCH")).otherwise(F.lit("HOLD"))
