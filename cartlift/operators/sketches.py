"""Mergeable quantile sketches: stored per day, merged for a cutoff (O-65, O-69a, O-69d; opt-in).

An exact cutoff ranks all values of the population each time.  A KLL sketch of
a day's values is a few kilobytes whatever the day held; sketches merge without
reading the values again, so a cutoff over any stretch of days costs one small
row per day.  The price is a rank error, bounded by ``k`` alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKETCH_K = 800


def rank_error(k: int = SKETCH_K) -> float:
    """Rank error of a single quantile that 99% of sketches keep (published
    constants of the KLL implementation; 0.35% at k = 800)."""
    return 2.296 / k ** 0.9723


def daily_sketches(df: DataFrame, value: str, day: Column, k: int = SKETCH_K) -> DataFrame:
    """(day, n, sketch): one row per day, built map-side first."""
    v = F.col(value).cast("double")
    return (df.where(v.isNotNull() & ~F.isnan(v)).groupBy(day.alias("day"))
            .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, k).alias("sketch")))


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Add days to a sketch table; days that are there already are replaced, others stay."""
    (sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged_quantiles(sketches: DataFrame, probs: Sequence[float], k: int = SKETCH_K, group_cols: Sequence[str] = ()) -> DataFrame:
    """``group_cols`` + (prob, value, n) of the merged sketches."""
    merged = sketches.groupBy(*group_cols).agg(F.kll_merge_agg_double("sketch", k).alias("_s"), F.sum("n").alias("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"),
                                        F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias("value")) for p in probs]))
    return (merged.where(F.col("n") > 0).select(*group_cols, "n", rows.alias("_q"))
            .select(*group_cols, "_q.prob", "_q.value", "n"))


def approximate_quantiles(df: DataFrame, value: str, probs: Sequence[float], k: int = SKETCH_K) -> DataFrame:
    """(prob, value) in one aggregate: the opt-in stand-in for exact quantiles."""
    return merged_quantiles(daily_sketches(df, value, F.lit(0), k), probs, k).select("prob", "value")


def rank_check(df: DataFrame, value: str, cutoff: float, prob: float, tolerance: float) -> DataFrame:
    """One row: n, share of values below and up to ``cutoff``, and whether
    ``prob`` lies between them, ``tolerance`` of rank allowed."""
    v = F.col(value).cast("double")
    s = df.where(v.isNotNull() & ~F.isnan(v)).agg(
        F.count(F.lit(1)).alias("n"), F.avg((v < F.lit(cutoff)).cast("double")).alias("below"),
        F.avg((v <= F.lit(cutoff)).cast("double")).alias("up_to"))
    return s.withColumn("within", (F.col("below") <= prob + tolerance) & (F.col("up_to") >= prob - tolerance))
