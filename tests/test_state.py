"""Customer state from one scan, merged from parts."""

import numpy as np
import pandas as pd
from conftest import SF001

from pyspark.sql import functions as F

from cartlift.functions.scalars import ntz_lit
from cartlift.operators import features as FE
from cartlift.operators import state as S
from cartlift.sources.fixtures import fixture_tables


def table(df):
    return df.toPandas().set_index("client_id").sort_index()


def same(a, b):
    pd.testing.assert_frame_equal(a.astype(float), b[a.columns].astype(float), rtol=1e-9, atol=1e-9)


def test_state_gives_the_rollups_features(spark):
    lines = fixture_tables(spark, SF001)["purchases"]
    ref = ntz_lit(FE.reference_time_value(lines))
    want = table(FE.purchase_features(lines, ref))
    baskets = S.basket_rollup(lines).cache()
    same(table(S.features_from_state(S.customer_sums(baskets), S.presence(baskets), ref)), want)
    # three parts by transaction, merged in two steps
    parts = [baskets.where(F.col("transaction_id") % 3 == k) for k in range(3)]
    sums = S.merge_sums(S.merge_sums(*[S.customer_sums(p) for p in parts[:2]]), S.customer_sums(parts[2]))
    held = S.merge_presence(*[S.presence(p) for p in parts])
    same(table(S.features_from_state(sums, held, ref)), want)
    baskets.unpersist()


def test_one_scan_reads_the_lines_once(spark):
    t = fixture_tables(spark, SF001)
    df = FE.customer_features(t["train"], t["clients"], t["purchases"], gender_cats=("F", "M", "U"), one_scan=True)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan  # the lines are in the written baskets already
    same(table(df), table(FE.customer_features(t["train"], t["clients"], t["purchases"], gender_cats=("F", "M", "U"))))
    lines = S.basket_rollup(t["purchases"])._jdf.queryExecution().optimizedPlan().toString()
    assert lines.count("l_partkey") and lines.count("Relation") == 2  # one scan of the lines, one of the orders


def test_equal_large_spends_have_no_deviation(spark):
    """No difference of large squares: equal amounts give exactly 0 after merging."""
    rows = [("a", i, 123456789.01) for i in range(7)] + [("b", 100 + i, x) for i, x in enumerate([1e8, 1e8 + 1, 1e8 + 2])] + [
        ("c", 200, None), ("d", 300, 5.0)]
    base = spark.createDataFrame(rows, "client_id string, transaction_id long, purchase_sum double")
    for dst in ("transaction_datetime",):
        base = base.withColumn(dst, F.lit("2024-01-01").cast("timestamp_ntz"))
    for src, _ in FE.TX_MAX_COLS:
        if src not in base.columns:
            base = base.withColumn(src, F.lit(1.0))
    base = base.withColumns({"product_id": F.lit(None).cast("long"), "store_id": F.lit(3)})
    parts = [S.basket_rollup(base.where(F.col("transaction_id") % 2 == k)) for k in (0, 1)]
    sums = S.merge_sums(*[S.customer_sums(p) for p in parts])
    got = table(S.features_from_state(sums, S.merge_presence(*[S.presence(p) for p in parts]), F.lit("2024-01-02").cast("timestamp_ntz")))
    assert got.spend_std["a"] == 0 and abs(got.spend_std["b"] - 1) < 1e-6
    assert np.isnan(got.spend_std["d"]) and np.isnan(got.spend_mean["c"]) and got.n_tx["c"] == 1
    assert (got.n_products == 0).all() and (got.n_stores == 1).all() and (got.recency_days == 1).all()
