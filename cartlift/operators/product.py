"""Product analytics: core metrics, cohort retention, RFM segments (O-18..O-27)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlift.functions.dates import month_diff, month_start
from cartlift.functions.scalars import double_lit, first_value
from cartlift.operators.ranking import exact_quantiles, global_rank, ntile_from_rank
from cartlift.sources.raw import ID

SEGMENTS = ("champions", "at_risk", "mid")


def core_metrics(features: DataFrame, rank_kw: dict | None = None) -> DataFrame:
    """One-row health readout (O-18): customers, mean frequency and spend over
    customers with history, exact median recency (distributed)."""
    agg = features.agg(F.count(F.lit(1)).alias("customers"),
                       F.round(F.avg("n_tx"), 2).alias("avg_purchase_frequency"),
                       F.round(F.avg("spend_total"), 2).alias("avg_monetary_per_customer"))
    med = first_value(exact_quantiles(features, "recency_days", [0.5], **(rank_kw or {})), "value")
    return agg.withColumn("median_recency_days", double_lit(med))


def time_quality(purchases: DataFrame) -> DataFrame:
    """Lines and transactions whose purchase time did not parse (O-05/O-22);
    they count in the feature rollups but are left out of cohorts."""
    bad = F.col("transaction_datetime").isNull()
    return purchases.agg(F.count(F.lit(1)).alias("lines"),
                         F.sum(bad.cast("long")).alias("lines_without_time"),
                         F.countDistinct(F.when(bad, F.struct(ID, "transaction_id"))).alias("transactions_without_time"))


def active_months(purchases: DataFrame) -> DataFrame:
    """Distinct (customer, month) with a purchase (O-20); NULL times left out."""
    return (purchases.where(F.col("transaction_datetime").isNotNull())
            .select(ID, month_start("transaction_datetime").alias("active_month")).distinct())


def cohort_activity(purchases: DataFrame) -> DataFrame:
    """(cohort, month_offset, n_active) (O-19..O-21).

    One scan of the purchases: the distinct customer-months are built once
    (de-duplicated map-side), the acquisition month is their minimum per
    customer (a window over at most #months rows per customer), and the
    result is a small group-by.
    """
    act = active_months(purchases)
    w = Window.partitionBy(ID)
    cohorts = act.withColumn("cohort", F.min("active_month").over(w))
    return (cohorts.groupBy("cohort", month_diff("cohort", "active_month").alias("month_offset"))
            .agg(F.count(F.lit(1)).alias("n_active")))


def cohort_retention(purchases: DataFrame) -> DataFrame:
    """Long-form retention: n_active / cohort size at offset 0 (O-22)."""
    act = cohort_activity(purchases)
    w = Window.partitionBy("cohort")
    base = F.max(F.when(F.col("month_offset") == 0, F.col("n_active"))).over(w)
    return act.withColumn("retention", F.try_divide(F.col("n_active").cast("double"), base))


def cohort_matrix(retention: DataFrame, last_cohorts: int = 6, offsets: int = 6) -> DataFrame:
    """Wide view: the latest cohorts by the first offsets (O-23)."""
    latest = retention.select("cohort").distinct().orderBy(F.col("cohort").desc()).limit(last_cohorts)
    small = (retention.where(F.col("month_offset") < offsets)
             .join(F.broadcast(latest), "cohort", "left_semi"))  # <= last_cohorts keys
    wide = small.groupBy("cohort").pivot("month_offset", list(range(offsets))).agg(F.first("retention"))
    return wide.select("cohort", *[F.col(str(i)).alias(f"m{i}") for i in range(offsets)])


def rfm_scores(features: DataFrame, rank_kw: dict | None = None) -> DataFrame:
    """R, F, M quintiles as SQL NTILE(5) (O-24), without a single partition.

    R orders recency descending (5 = most recent); ties break by client_id.
    Only customers with recency, frequency and spend are scored.
    """
    kw = dict(rank_kw or {})
    rfm_in = features.select(ID, "recency_days", "n_tx", "spend_total").where(
        F.col("recency_days").isNotNull() & F.col("n_tx").isNotNull() & F.col("spend_total").isNotNull())
    n = kw.pop("n", None)
    if n is None:
        n = rfm_in.count()
    ranked = rfm_in
    for name, col, desc in (("R", "recency_days", True), ("F", "n_tx", False), ("M", "spend_total", False)):
        ranked = global_rank(ranked, [(col, desc)], tie_col=ID, rank_col=f"_r{name}", n=n, **kw)
    nn = F.lit(n)
    return ranked.select(ID, *[ntile_from_rank(F.col(f"_r{k}"), nn, 5).alias(k) for k in "RFM"])


def segment_rule(r: str = "R", f: str = "F") -> F.Column:
    """champions: R>=4 and F>=4; at_risk: R<=2 and F<=2; else mid (O-25).
    M is scored but not used by the rule."""
    return (F.when((F.col(r) >= 4) & (F.col(f) >= 4), "champions")
            .when((F.col(r) <= 2) & (F.col(f) <= 2), "at_risk").otherwise("mid"))


def rfm_segments(features: DataFrame, rank_kw: dict | None = None) -> DataFrame:
    s = rfm_scores(features, rank_kw)
    return s.withColumn("rfm_segment", segment_rule())


def attach_segments(features: DataFrame, rank_kw: dict | None = None) -> DataFrame:
    """Feature table plus ``rfm_segment``; unscored customers are ``unknown`` (O-26)."""
    seg = rfm_segments(features, rank_kw).select(ID, "rfm_segment")
    return (features.join(seg, ID, "left")
            .withColumn("rfm_segment", F.coalesce(F.col("rfm_segment"), F.lit("unknown"))))


def segment_sizes(df: DataFrame) -> DataFrame:
    """Customers per segment (O-27)."""
    return df.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("customers"))
