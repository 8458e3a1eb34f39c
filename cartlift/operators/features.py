"""Customer feature table: product lines -> transactions -> customers (O-08..O-17).

Plan shape (see README "Physical plan"): every aggregate is algebraic, so
Spark combines map-side before each shuffle.  The line->transaction rollup
shuffles on (client_id, transaction_id), which spreads a customer who owns a
third of all lines over all reducers; the transaction->customer rollup then
ships one partial row per (customer, map task).  Repartitioning the lines by
``client_id`` up front would save one exchange but put a hot customer's lines
into a single task, so it is deliberately not done.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlift.functions.dates import floor_days
from cartlift.functions.scalars import first_value, ntz_lit
from cartlift.sources.raw import ARM, ID, OUTCOME, reference_time

TX_MAX_COLS = (("purchase_sum", "tx_sum"), ("transaction_datetime", "tx_time"),
               ("regular_points_received", "tx_pts_received"),
               ("regular_points_spent", "tx_pts_spent"),
               ("express_points_received", "tx_exp_received"),
               ("express_points_spent", "tx_exp_spent"),
               ("trn_sum_from_iss", "tx_sum_from_iss"),
               ("trn_sum_from_red", "tx_sum_from_red"))

PURCHASE_FEATURES = ("n_tx", "spend_total", "spend_mean", "spend_std", "basket_mean",
                     "pts_received", "pts_spent", "exp_pts_received", "exp_pts_spent",
                     "sum_from_iss_mean", "sum_from_red_mean", "n_products", "n_stores",
                     "recency_days", "tenure_days")


def transaction_rollup(purchases: DataFrame) -> DataFrame:
    """One row per (client, transaction) (O-08).

    Transaction-level values repeat on each line, so MAX de-duplicates them
    (a SUM would multiply spend by basket size).
    """
    aggs = [F.max(src).alias(dst) for src, dst in TX_MAX_COLS]
    aggs.insert(1, F.countDistinct("product_id").alias("tx_items"))
    return purchases.groupBy(ID, "transaction_id").agg(*aggs).select(
        ID, "transaction_id", "tx_sum", "tx_items", "tx_time", "tx_pts_received", "tx_pts_spent",
        "tx_exp_received", "tx_exp_spent", "tx_sum_from_iss", "tx_sum_from_red")


def customer_rollup(tx: DataFrame) -> DataFrame:
    """One row per customer from the transaction rollup (O-09)."""
    return tx.groupBy(ID).agg(
        F.count(F.lit(1)).alias("n_tx"),
        F.sum("tx_sum").alias("spend_total"),
        F.avg("tx_sum").alias("spend_mean"),
        F.stddev_samp("tx_sum").alias("spend_std"),
        F.avg("tx_items").alias("basket_mean"),
        F.max("tx_time").alias("last_tx"),
        F.min("tx_time").alias("first_tx"),
        F.sum("tx_pts_received").alias("pts_received"),
        F.sum("tx_pts_spent").alias("pts_spent"),
        F.sum("tx_exp_received").alias("exp_pts_received"),
        F.sum("tx_exp_spent").alias("exp_pts_spent"),
        F.avg("tx_sum_from_iss").alias("sum_from_iss_mean"),
        F.avg("tx_sum_from_red").alias("sum_from_red_mean"),
    )


def breadth_cells(purchases: DataFrame, parts: int) -> DataFrame:
    """Distinct (client, product) and (client, store) cells in ``parts`` partitions,
    the other value being NULL; a client without any value keeps a cell.

    A basket's cells are made distinct before they move, in the tasks of the
    lines where these lie by transaction: a store comes once for each basket.
    """
    cells = purchases.select(ID, "transaction_id", F.inline(F.array(
        F.struct(F.col("product_id"), F.lit(None).cast(purchases.schema["store_id"].dataType).alias("store_id")),
        F.struct(F.lit(None).cast(purchases.schema["product_id"].dataType).alias("product_id"), F.col("store_id")))))
    return (cells.distinct().drop("transaction_id")
            .repartition(parts, ID, "product_id", "store_id").distinct())


def customer_breadth(purchases: DataFrame, approximate: bool = False, rsd: float = 0.01,
                     parts: int | None = None) -> DataFrame:
    """Distinct products and stores per customer (O-10).

    Two exact distinct counts in one aggregate: Catalyst expands each row
    once per distinct column and de-duplicates (client, value) map-side.
    Spark merges the partitions of that by compressed bytes, some 5 million
    cells a task; with ``parts`` (many lines) the cells are dealt by number.
    ``approximate=True`` uses HyperLogLog++ sketches instead (bounded state,
    relative SD ``rsd``).
    """
    if approximate:
        return purchases.groupBy(ID).agg(
            F.approx_count_distinct("product_id", rsd).alias("n_products"),
            F.approx_count_distinct("store_id", rsd).alias("n_stores"))
    if parts:
        return breadth_cells(purchases, parts).groupBy(ID).agg(
            F.count("product_id").alias("n_products"), F.count("store_id").alias("n_stores"))
    return purchases.groupBy(ID).agg(F.countDistinct("product_id").alias("n_products"),
                                     F.countDistinct("store_id").alias("n_stores"))


def purchase_features(purchases: DataFrame, ref_time, approximate_breadth: bool = False,
                      parts: int | None = None, customers: DataFrame | None = None) -> DataFrame:
    """Rollups joined, plus floored ``recency_days``/``tenure_days`` (O-11, O-12).

    ``ref_time`` is a TIMESTAMP_NTZ literal column (see :func:`reference_time_value`);
    ``customers`` is the customer rollup, where it was written already.
    """
    cust = customer_rollup(transaction_rollup(purchases)) if customers is None else customers
    feats = cust.join(customer_breadth(purchases, approximate_breadth, parts=parts), ID, "left")
    return feats.select(
        ID, *PURCHASE_FEATURES[:13],
        floor_days(ref_time, "last_tx").alias("recency_days"),
        floor_days("last_tx", "first_tx").alias("tenure_days"))


def reference_time_value(purchases: DataFrame, as_of=None):
    """The reference ("campaign start") time as a driver scalar (O-06):
    ``as_of`` if given, else the latest purchase time (a one-column scan)."""
    return as_of if as_of is not None else first_value(reference_time(purchases))


def client_features(clients: DataFrame, ref_time, null_future_dates: bool = False) -> DataFrame:
    """Demographics and loyalty-card date features (O-13).

    Each derived column exists only when its source column exists.
    ``null_future_dates=True`` blanks card dates after the reference time
    (leak-safe); the default keeps them, as the original analysis did.
    """
    cols = set(clients.columns)
    demo = [c for c in ("age", "gender") if c in cols]
    dates = [c for c in ("first_issue_date", "first_redeem_date") if c in cols]
    cl = clients.select(ID, *demo, *dates)
    if null_future_dates:
        for c in dates:
            cl = cl.withColumn(c, F.when(F.col(c) <= ref_time, F.col(c)))
    out = [F.col(ID), *[F.col(c) for c in demo]]
    if "first_issue_date" in dates:
        out.append(floor_days(ref_time, "first_issue_date").alias("issue_tenure_days"))
    if "first_redeem_date" in dates:
        out.append(F.col("first_redeem_date").isNotNull().cast("double").alias("has_redeemed"))
        out.append(floor_days(ref_time, "first_redeem_date").alias("redeem_recency_days"))
        if "first_issue_date" in dates:
            out.append(floor_days("first_redeem_date", "first_issue_date").alias("issue_to_redeem_days"))
    return cl.select(*out)


def gender_categories(train: DataFrame, clients: DataFrame) -> list[str]:
    """Sorted distinct non-NULL genders of the experiment customers.

    Only categories that occur in the joined table get a column: one found
    outside ``train`` alone would add a constant column or become the dropped
    base.  Each category becomes a feature column, so the list is as short as
    the feature table is narrow; pass ``gender_cats`` to skip this scan.
    """
    known = clients.where(F.col("gender").isNotNull()).select(ID, "gender")
    rows = known.join(train.select(ID), ID, "left_semi").select("gender").distinct().collect()
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, col: str, categories: Sequence[str]) -> DataFrame:
    """Dummies for ``col``: sorted categories, first dropped, plus ``<col>_nan``
    for NULL (present even when no value is NULL) (O-15)."""
    cats = sorted(categories)
    dummies = [F.when(F.col(col) == F.lit(c), 1).otherwise(0).alias(f"{col}_{c}") for c in cats[1:]]
    dummies.append(F.when(F.col(col).isNull(), 1).otherwise(0).alias(f"{col}_nan"))
    keep = [F.col(c) for c in df.columns if c != col]
    return df.select(*keep, *dummies)


def customer_features(train: DataFrame, clients: DataFrame, purchases: DataFrame,
                      as_of=None, gender_cats: Sequence[str] | None = None,
                      null_future_dates: bool = False, approximate_breadth: bool = False,
                      one_scan: bool = False, parts: int | None = None) -> DataFrame:
    """One feature row per experiment customer (O-05..O-16).

    Every ``train`` customer is kept; customers without purchases have NULL
    purchase features, customers without a client row have NULL client
    features.  Row order is not defined (ties are broken by id downstream).
    ``one_scan`` reads the lines once, into a written table of baskets
    (:mod:`cartlift.operators.state`); otherwise the frame stays lazy.
    ``parts`` (many lines): partitions of the distinct cells and of ``train``,
    whose own joins are then not in the tasks that join the features.  The
    customer rollup is then written, one row per customer, and the reference
    time is the latest of its times, so it needs no pass over the lines.
    """
    if one_scan and not approximate_breadth:
        from cartlift.operators import state
        from cartlift.session import materialize
        baskets = materialize(state.basket_rollup(purchases), "baskets")
        latest = as_of if as_of is not None else first_value(baskets.agg(F.max("tx_time")))
        ref = ntz_lit(latest)
        feats = state.features_from_state(state.customer_sums(baskets), state.presence(baskets), ref)
    else:
        rollup = None
        if parts:
            from cartlift.session import materialize
            rollup = materialize(customer_rollup(transaction_rollup(purchases)), "customers")
            if as_of is None:
                as_of = first_value(rollup.agg(F.max("last_tx")))
            ref = ntz_lit(as_of)
        else:
            ref = ntz_lit(reference_time_value(purchases, as_of))
        feats = purchase_features(purchases, ref, approximate_breadth, parts, rollup)
    cl = client_features(clients, ref, null_future_dates)
    own = train.select(ID, OUTCOME, ARM)
    df = ((own.repartition(parts, ID) if parts else own).join(feats, ID, "left").join(cl, ID, "left"))
    if "gender" in df.columns:
        cats = gender_cats if gender_cats is not None else gender_categories(train, clients)
        df = one_hot(df, "gender", cats)
    return df


def feature_names(df: DataFrame) -> list[str]:
    """Numeric model features: everything but id, outcome and arm (O-17).

    String columns (the RFM segment) are excluded; 0/1 dummies count.
    """
    from cartlift.functions.columns import numeric_columns
    return numeric_columns(df, exclude=(ID, OUTCOME, ARM))
