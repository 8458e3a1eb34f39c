"""Top-k% targeting policy, its value and guardrails (O-64..O-68)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlift.functions.scalars import double_lit, first_value
from cartlift.operators.ranking import exact_quantiles
from cartlift.operators.sketches import approximate_quantiles
from cartlift.sources.raw import ARM, ID, OUTCOME


def score_cutoff(scored: DataFrame, score_col: str, k: float, rank_kw: dict | None = None,
                 approximate: bool = False) -> DataFrame:
    """One row ``cutoff``: the (1-k) quantile of scores, linear interpolation;
    ``approximate`` takes a quantile sketch's value instead of ranking all scores."""
    if approximate:
        return approximate_quantiles(scored, score_col, [1.0 - k]).select(F.col("value").alias("cutoff"))
    q = exact_quantiles(scored, score_col, [1.0 - k], **(rank_kw or {}))
    return q.select(F.col("value").alias("cutoff"))


def targeting_policy(scored: DataFrame, score_col: str, k: float = 0.30,
                     rank_kw: dict | None = None, approximate: bool = False) -> DataFrame:
    """``targeted`` = score >= cutoff; every tie at the cutoff is included (O-65)."""
    cut = first_value(score_cutoff(scored, score_col, k, rank_kw, approximate), "cutoff")
    return (scored.withColumn("cutoff", double_lit(cut))
            .withColumn("targeted", F.col(score_col) >= F.col("cutoff")))


def _uplift_where(mask: Column) -> Column:
    y = F.col(OUTCOME).cast("double")
    return (F.avg(F.when(mask & (F.col(ARM) == 1), y)) - F.avg(F.when(mask & (F.col(ARM) == 0), y)))


def policy_value(targeted: DataFrame, k: float = 0.30) -> DataFrame:
    """Measured uplift in and outside the target, separation, captured share (O-66/O-67).

    Uplift is NULL when an arm is empty; separation is NULL when the rest's
    uplift is 0 or NULL; captured = incr_top / (incr_top + incr_rest), NULL at 0.
    """
    top = F.col("targeted")
    a = targeted.agg(F.first("cutoff").alias("cutoff"),
                     F.sum(top.cast("int")).cast("bigint").alias("n_top"),
                     F.sum((~top).cast("int")).cast("bigint").alias("n_rest"),
                     _uplift_where(top).alias("uplift_top"), _uplift_where(~top).alias("uplift_rest"))
    incr_top = F.col("uplift_top") * F.col("n_top")
    incr_all = incr_top + F.col("uplift_rest") * F.col("n_rest")
    return a.select(F.lit(k).alias("k_percent"), "cutoff", "n_top", "n_rest", "uplift_top", "uplift_rest",
                    F.try_divide(F.col("uplift_top"), F.col("uplift_rest")).alias("separation"),
                    incr_top.alias("incr_top"), incr_all.alias("incr_all"),
                    F.try_divide(incr_top, incr_all).alias("captured"),
                    F.lit(k).alias("send_cost"), F.lit(1.0 - k).alias("spend_saved"))


def uplift_at_k(targeted: DataFrame, k: float = 0.30) -> DataFrame:
    """Treated minus control rate within the top k% (O-64)."""
    return targeted.agg(_uplift_where(F.col("targeted")).alias("uplift_at_k")).withColumn(
        "k_percent", F.lit(k))


def policy_guardrails(targeted: DataFrame) -> DataFrame:
    """Champions not over-represented in the target; target uplift positive and
    above the rest (the second rule is stated in the original text only) (O-68)."""
    champ = (F.col("rfm_segment") == "champions").cast("double")
    top = F.col("targeted")
    a = targeted.agg(F.avg(F.when(top, champ)).alias("champions_share"),
                     F.avg(champ).alias("champions_base"),
                     _uplift_where(top).alias("_up_top"), _uplift_where(~top).alias("_up_rest"))
    return a.select("champions_share", "champions_base",
                    (F.col("champions_share") <= F.col("champions_base")).alias("champions_ok"),
                    F.coalesce((F.col("_up_top") > 0) & (F.col("_up_top") > F.col("_up_rest")),
                               F.lit(False)).alias("separation_ok"))


def policy_economics(value: DataFrame, unit_value: float, unit_cost: float) -> DataFrame:
    """Optional money view of :func:`policy_value` (O-67): incremental
    responses times a unit value minus sends times a unit cost, for the top-k%
    policy and for treating everyone."""
    n_all = F.col("n_top") + F.col("n_rest")
    net_top = F.col("incr_top") * F.lit(unit_value) - F.col("n_top") * F.lit(unit_cost)
    net_all = F.col("incr_all") * F.lit(unit_value) - n_all * F.lit(unit_cost)
    return value.select("k_percent", net_top.alias("net_value_top"), net_all.alias("net_value_all"),
                        (net_top - net_all).alias("net_gain_vs_all"))
