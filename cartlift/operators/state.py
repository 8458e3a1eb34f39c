"""Customer purchase state from one scan of the lines, merged day by day (O-06, O-08, O-09, O-10, O-12).

:func:`basket_rollup` reads the lines once: one row per (client, transaction)
with the transaction's values and the sets of its products and stores.  All
that the feature table needs of the lines follows from it: the latest time, the
transaction sums, and who bought what where.

For a history that grows, two small tables are kept instead of the lines:
*sums* (a row per client: counts, totals, first and last time, mean and squared
deviations of the spend) and *presence* (a row per client and product or store).
Both merge with those of a new day without reading the days before: sums add up,
deviations are combined pairwise (no difference of large squares), presence
rows are united.  A transaction must lie within one day's input.  A client that
owns a third of all lines is one row of sums and, in presence, spread over all
tasks by product and store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlift.functions.dates import floor_days
from cartlift.operators.features import PURCHASE_FEATURES, TX_MAX_COLS
from cartlift.sources.raw import ID

ADDED = {"pts_received": "tx_pts_received", "pts_spent": "tx_pts_spent", "exp_pts_received": "tx_exp_received",
         "exp_pts_spent": "tx_exp_spent", "iss_sum": "tx_sum_from_iss", "red_sum": "tx_sum_from_red", "spend_total": "tx_sum"}
COUNTED = {"iss_n": "tx_sum_from_iss", "red_n": "tx_sum_from_red"}


def basket_rollup(purchases: DataFrame) -> DataFrame:
    """One row per (client, transaction): O-08's values, ``items`` and ``stores``."""
    return purchases.groupBy(ID, "transaction_id").agg(
        *[F.max(src).alias(dst) for src, dst in TX_MAX_COLS],
        F.collect_set("product_id").alias("items"), F.collect_set("store_id").alias("stores"))


def customer_sums(baskets: DataFrame) -> DataFrame:
    """Mergeable sums per client; ``spend`` = (n, mean, squared deviations) of the known transaction sums."""
    x = F.col("tx_sum").cast("double")
    return baskets.groupBy(ID).agg(
        F.count(F.lit(1)).alias("n_tx"), F.sum(F.size("items")).alias("basket_items"),
        *[F.sum(c).alias(n) for n, c in ADDED.items()], *[F.count(c).alias(n) for n, c in COUNTED.items()],
        F.struct(F.count(x).cast("double").alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
                 (F.coalesce(F.var_pop(x), F.lit(0.0)) * F.count(x)).alias("dev")).alias("spend"),
        F.max("tx_time").alias("last_tx"), F.min("tx_time").alias("first_tx"))


def presence(baskets: DataFrame) -> DataFrame:
    """Distinct (client, kind, value), kind ``p`` for products and ``s`` for stores."""
    def cells(kind: str, c: str) -> Column:
        return F.transform(c, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value")))
    return (baskets.select(ID, F.explode(F.concat(cells("p", "items"), cells("s", "stores"))).alias("c"))
            .select(ID, "c.kind", "c.value").distinct())


def _combined(spends: Column) -> Column:
    """Fold of (n, mean, dev) of a client's parts (one for each merged state)."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("dev"))

    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        d = b["mean"] - a["mean"]
        return F.when(n == 0, a).otherwise(F.struct(
            n.alias("n"), (a["mean"] + d * b["n"] / F.greatest(n, F.lit(1.0))).alias("mean"),
            (a["dev"] + b["dev"] + d * d * a["n"] * b["n"] / F.greatest(n, F.lit(1.0))).alias("dev")))
    return F.aggregate(spends, zero, add)


def merge_sums(*parts: DataFrame) -> DataFrame:
    """Sums of several disjoint sets of transactions as one."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    added = ["n_tx", "basket_items", *ADDED, *COUNTED]
    return both.groupBy(ID).agg(*[F.sum(c).alias(c) for c in added], _combined(F.collect_list("spend")).alias("spend"),
                                F.max("last_tx").alias("last_tx"), F.min("first_tx").alias("first_tx"))


def merge_presence(*parts: DataFrame) -> DataFrame:
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.distinct()


def features_from_state(sums: DataFrame, held: DataFrame, ref_time: Column) -> DataFrame:
    """Purchase features (O-11, O-12), as :func:`cartlift.operators.features.purchase_features` gives them."""
    breadth = held.groupBy(ID).agg(F.sum((F.col("kind") == "p").cast("long")).alias("n_products"),
                                   F.sum((F.col("kind") == "s").cast("long")).alias("n_stores"))
    s = F.col("spend")
    cols = {"spend_mean": F.when(s["n"] > 0, F.col("spend_total") / s["n"]),
            "spend_std": F.when(s["n"] > 1, F.sqrt(s["dev"] / (s["n"] - 1))),
            "basket_mean": F.col("basket_items") / F.col("n_tx"),
            "sum_from_iss_mean": F.try_divide("iss_sum", "iss_n"), "sum_from_red_mean": F.try_divide("red_sum", "red_n"),
            "n_products": F.coalesce("n_products", F.lit(0)), "n_stores": F.coalesce("n_stores", F.lit(0))}
    return sums.join(breadth, ID, "left").withColumns(cols).select(
        ID, *PURCHASE_FEATURES[:13], floor_days(ref_time, "last_tx").alias("recency_days"),
        floor_days("last_tx", "first_tx").alias("tenure_days"))
