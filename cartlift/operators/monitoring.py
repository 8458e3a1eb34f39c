"""Drift monitoring and the exploration slice (O-69a..f).

PSI edges are exact reference-period quantiles computed per column in one
distributed ranking; the edge table (columns x (bins - 1) values) is the only
thing broadcast.  Period halves, exploration and the coin flip are keyed
uniforms, so a customer's assignment never depends on row position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlift.functions.hashing import keyed_uniform
from cartlift.functions.scalars import double_lit, first_value
from cartlift.operators.effects import ate_naive
from cartlift.operators.ranking import exact_quantiles
from cartlift.operators.sketches import approximate_quantiles
from cartlift.sources.raw import ID

SHARE_FLOOR = 1e-6


def period_halves(df: DataFrame, salt: str = "period") -> DataFrame:
    """Reference vs recent by a keyed half split (O-69c); real periods replace it."""
    return df.withColumn("period", F.when(keyed_uniform(ID, salt) < F.lit(0.5), "reference").otherwise("recent"))


def psi_flag(psi: Column) -> Column:
    """OK below 0.1, WATCH below 0.25, else DRIFT (O-69b)."""
    return F.when(psi < 0.1, "OK").when(psi < 0.25, "WATCH").otherwise("DRIFT")


def psi(df: DataFrame, cols: Sequence[str], period_col: str = "period", reference: str = "reference",
        actual: str = "recent", bins: int = 10, rank_kw: dict | None = None) -> DataFrame:
    """Population Stability Index per column between two periods (O-69a).

    Inner edges are the reference quantiles at i / bins; outer edges are
    -inf / +inf; bins are [a, b) with the last closed, i.e. the bin of x is the
    number of inner edges <= x (repeated edges leave empty bins).  Shares are
    floored at 1e-6; PSI = sum (a - e) ln(a / e).  NULL values are left out.
    """
    long = df.select(F.col(period_col).alias("_period"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("r")).select("_period", "r.feature", "r.value").where(F.col("value").isNotNull())
    probs = [i / bins for i in range(1, bins)]
    q = exact_quantiles(long.where(F.col("_period") == reference), "value", probs,
                        group_cols=["feature"], **(rank_kw or {}))
    edges = q.groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("prob", "value"))), lambda s: s["value"]).alias("edges"))
    # edges: one row per column with bins - 1 values
    binned = long.join(F.broadcast(edges), "feature").withColumn(
        "bin", F.size(F.filter("edges", lambda e: e <= F.col("value"))))
    counts = binned.groupBy("feature", "_period", "bin").agg(F.count(F.lit(1)).alias("cnt"))
    totals = counts.groupBy("feature", "_period").agg(F.sum("cnt").alias("tot"))
    grid = edges.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    share = lambda label: (counts.where(F.col("_period") == label)
                           .join(totals, ["feature", "_period"])
                           .select("feature", "bin", (F.col("cnt") / F.col("tot")).alias(label)))
    full = (grid.join(share(reference), ["feature", "bin"], "left")
            .join(share(actual), ["feature", "bin"], "left"))
    e = F.greatest(F.coalesce(F.col(reference), F.lit(0.0)), F.lit(SHARE_FLOOR))
    a = F.greatest(F.coalesce(F.col(actual), F.lit(0.0)), F.lit(SHARE_FLOOR))
    out = full.groupBy("feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))
    return out.withColumn("flag", psi_flag(F.col("psi")))


def epsilon_assignment(scored: DataFrame, score_col: str, epsilon: float = 0.05, k: float = 0.30,
                       cycle: str = "0", rank_kw: dict | None = None, approximate: bool = False) -> DataFrame:
    """Epsilon-greedy actions (O-69d): a keyed random epsilon slice is a mini
    A/B (coin 0.5); the rest get the top-k% policy with the cutoff computed on
    the exploit rows only (from a quantile sketch if ``approximate``).  The cycle id salts both uniforms."""
    explore = keyed_uniform(ID, f"explore:{cycle}") < F.lit(epsilon)
    coin = keyed_uniform(ID, f"coin:{cycle}") < F.lit(0.5)
    marked = scored.withColumn("_explore", explore).withColumn("_coin", coin)
    exploit = marked.where(~F.col("_explore"))
    q = (approximate_quantiles(exploit, score_col, [1.0 - k]) if approximate
         else exact_quantiles(exploit, score_col, [1.0 - k], **(rank_kw or {})))
    marked = marked.withColumn("cutoff", double_lit(first_value(q, "value")))
    action = (F.when(F.col("_explore") & F.col("_coin"), "explore_treat")
              .when(F.col("_explore"), "explore_control")
              .when(F.col(score_col) >= F.col("cutoff"), "exploit_treat")
              .otherwise("exploit_skip"))
    return marked.withColumn("action", action).drop("_explore", "_coin")


def epsilon_buckets(assigned: DataFrame) -> DataFrame:
    """Rows per action and share of all rows (O-69e)."""
    counts = assigned.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over at most four action rows
    return counts.select("action", "n", (F.col("n") / total).alias("share"))


def explore_share(assigned: DataFrame) -> DataFrame:
    is_explore = F.col("action").startswith("explore")
    return assigned.agg(F.sum(is_explore.cast("int")).cast("bigint").alias("n_explore"),
                        F.avg(is_explore.cast("double")).alias("explore_share"))


def explore_revalidation(assigned: DataFrame) -> DataFrame:
    """Effect measured on the randomised explore slice only (O-69f)."""
    return ate_naive(assigned.where(F.col("action").startswith("explore")))
