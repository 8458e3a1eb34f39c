"""Drift cube: all columns and periods in one pass, against versioned reference profiles (O-69a, O-69c, E-1).

A *profile* is a small table (feature, version, valid_from, edges, expected):
inner bin edges, exact reference quantiles, and the reference share of each
bin.  Profiles are published as files, one folder per version; readers take the
version that was valid at a value's time, so new edges come in without touching
a running stream.

:func:`bin_counts` reads the data once for all columns and periods; its result,
(feature, version, period, bin) counts, is tiny, mergeable by addition, and all
that PSI of any period against the profile or any other period needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlift.operators.monitoring import SHARE_FLOOR, psi_flag
from cartlift.operators.ranking import exact_quantiles

KEYS = ["feature", "version", "period"]


def _long(df: DataFrame, cols: Sequence[str], *keys: Column) -> DataFrame:
    """(keys, feature, value) for every present value of ``cols``."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])
    return (df.select(*keys, F.explode(cells).alias("_cell")).select("*", "_cell.feature", "_cell.value").drop("_cell")
            .where(F.col("value").isNotNull() & ~F.isnan("value")))


def _bin(value: Column, edges: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e <= value))


def _shares(counts: Column, total: Column, bins: Column) -> Column:
    """Share of each bin 0..bins-1 from a map bin -> count, floored."""
    return F.transform(F.sequence(F.lit(0), bins - 1), lambda b: F.greatest(
        F.coalesce(F.element_at(counts, b), F.lit(0)) / total, F.lit(SHARE_FLOOR)))


def _psi(actual: Column, expected: Column) -> Column:
    terms = F.zip_with(actual, expected, lambda a, e: (a - e) * F.log(a / e))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def reference_profile(reference: DataFrame, cols: Sequence[str], version: int = 1, valid_from: str = "0001-01-01",
                      bins: int = 10, rank_kw: dict | None = None) -> DataFrame:
    """Profile of a reference slice: one row per column that has values in it."""
    long = _long(reference, cols)
    q = exact_quantiles(long, "value", [i / bins for i in range(1, bins)], group_cols=["feature"], **(rank_kw or {}))
    edges = q.groupBy("feature").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("prob", "value"))), lambda s: s["value"]).alias("edges"))
    counted = (long.join(F.broadcast(edges), "feature")  # one row per column
               .groupBy("feature", "edges", _bin(F.col("value"), F.col("edges")).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
               .groupBy("feature", "edges").agg(F.sum("cnt").alias("tot"),
                                                F.map_from_entries(F.collect_list(F.struct("bin", "cnt"))).alias("counts")))
    return counted.select("feature", F.lit(version).alias("version"), F.lit(valid_from).cast("timestamp_ntz").alias("valid_from"),
                          "edges", _shares(F.col("counts"), F.col("tot"), F.lit(bins)).alias("expected"))


def publish_profile(profile: DataFrame, path: str) -> None:
    """Write a profile as ``path/version=<n>``; a version that is published again is replaced."""
    versions = [r["version"] for r in profile.select("version").distinct().collect()]
    for v in versions:
        profile.where(F.col("version") == v).drop("version").coalesce(1).write.mode("overwrite").parquet(
            f"{path.rstrip('/')}/version={v}")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """All published versions, listed anew at each call."""
    return spark.read.parquet(path).select("feature", F.col("version").cast("int").alias("version"), "valid_from", "edges", "expected")


def _with_validity(profiles: DataFrame) -> DataFrame:
    """Each version with the time at which the feature's next one takes over."""
    later = profiles.select(F.col("feature").alias("_f"), F.col("valid_from").alias("_next"))
    return (profiles.join(later, (F.col("feature") == F.col("_f")) & (F.col("_next") > F.col("valid_from")), "left")
            .groupBy("feature", "version", "valid_from", "edges", "expected").agg(F.min("_next").alias("valid_to")))


def bin_counts(df: DataFrame, cols: Sequence[str], period: Column, profiles: DataFrame, ts: str | None = None) -> DataFrame:
    """Counts per (feature, version, period, bin), one pass over ``df``.

    Without ``ts`` every version bins every value (the newest is usually the
    only one given); with it a value meets the version valid at its time.
    ``profiles`` holds columns x versions rows and is broadcast.
    """
    keys = [period.alias("period")] + ([F.col(ts).alias("_at")] if ts else [])
    long = _long(df, cols, *keys)
    if ts:
        known = F.broadcast(_with_validity(profiles).select(F.col("feature").alias("_f"), "version", "edges", "valid_from", "valid_to"))
        met = long.join(known, (F.col("feature") == F.col("_f")) & (F.col("_at") >= F.col("valid_from"))
                        & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
    else:
        met = long.join(F.broadcast(profiles.select("feature", "version", "edges")), "feature")
    return met.groupBy(*KEYS, _bin(F.col("value"), F.col("edges")).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def period_shares(counts: DataFrame, profiles: DataFrame) -> DataFrame:
    """(feature, version, period, n, share of each bin, expected); counts of several passes are added up."""
    added = counts.groupBy(*KEYS, "bin").agg(F.sum("cnt").alias("cnt"))
    per = added.groupBy(*KEYS).agg(F.sum("cnt").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "cnt"))).alias("counts"))
    return (per.join(F.broadcast(profiles.select("feature", "version", "expected")), ["feature", "version"])
            .select(*KEYS, "n", _shares(F.col("counts"), F.col("n"), F.size("expected")).alias("share"), "expected"))


def psi_against_profile(counts: DataFrame, profiles: DataFrame) -> DataFrame:
    """PSI and flag of every (feature, version, period) against its profile."""
    out = period_shares(counts, profiles).select(*KEYS, "n", _psi(F.col("share"), F.col("expected")).alias("psi"))
    return out.withColumn("flag", psi_flag(F.col("psi")))


def psi_between(counts: DataFrame, profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """PSI of ``period`` against ``reference`` for the pairs asked for (one row
    per pair of periods), in the bins of each version."""
    s = period_shares(counts, profiles)
    ref = s.select("feature", "version", F.col("period").alias("reference"), F.col("share").alias("ref_share"))
    out = (s.join(F.broadcast(pairs), "period").join(ref, ["feature", "version", "reference"])
           .select(*KEYS, "reference", "n", _psi(F.col("share"), F.col("ref_share")).alias("psi")))
    return out.withColumn("flag", psi_flag(F.col("psi")))
