import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartlift.operators.ranking import (decile_from_rank, exact_quantiles, global_cumsum,
                                        global_rank, ntile_from_rank)


def _frame(spark, n=3000, distinct=5, parts=7, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n, dtype=np.int64),
                        "v": rng.integers(0, distinct, n).astype(float),
                        "g": rng.integers(0, 3, n).astype(np.int64)})
    return spark.createDataFrame(pdf).repartition(parts)


@pytest.mark.parametrize("desc", [False, True])
def test_global_rank_matches_row_number(spark, desc):
    df = _frame(spark)
    got = global_rank(df, [("v", desc)], tie_col="id", rows_per_bucket=100)
    order = F.col("v").desc() if desc else F.col("v").asc()
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy(order, "id")))
    bad = got.join(ref, "id").where(F.col("rank") != F.col("rn")).count()
    assert got.count() == 3000 and bad == 0


def test_global_rank_groups_and_heavy_tie(spark):
    # one value held by a third of all rows must still be split across buckets
    df = _frame(spark, n=3000, distinct=2, parts=3)
    got = global_rank(df, [("v", False)], tie_col="id", group_cols=["g"], rows_per_bucket=50)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert got.join(ref, "id").where(F.col("rank") != F.col("rn")).count() == 0


def test_global_cumsum(spark):
    df = _frame(spark)
    got = global_cumsum(df, [("v", True)], {"cs": F.col("v")}, tie_col="id", rows_per_bucket=64)
    w = Window.orderBy(F.col("v").desc(), "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("rc", F.sum("v").over(w))
    assert got.join(ref, "id").where(F.abs(F.col("cs") - F.col("rc")) > 1e-9).count() == 0


@pytest.mark.parametrize("n", [12, 23, 1000, 1001])
def test_ntile_and_decile_formulas(spark, n):
    df = spark.range(1, n + 1).withColumnRenamed("id", "r")
    nn = F.lit(n)
    out = df.select("r", ntile_from_rank(F.col("r"), nn, 5).alias("t"),
                    decile_from_rank(F.col("r"), nn).alias("d"),
                    F.ntile(5).over(Window.orderBy("r")).alias("t_ref")).toPandas()
    assert (out.t == out.t_ref).all()
    ref = pd.qcut(pd.Series(np.arange(1, n + 1, dtype=float)), 10, labels=False)
    assert (out.sort_values("r").d.to_numpy() == ref.to_numpy()).all()


def test_decile_23_sizes(spark):
    n = 23
    d = spark.range(1, n + 1).select(decile_from_rank(F.col("id"), F.lit(n)).alias("d")).toPandas()
    assert d.d.value_counts().sort_index().tolist() == [3, 2, 2, 2, 3, 2, 2, 2, 2, 3]


def test_ntile_ties_sizes(spark):
    df = spark.createDataFrame([(i, 7.0) for i in range(12)], "id long, v double")
    r = global_rank(df, [("v", True)], tie_col="id")
    t = r.select("id", ntile_from_rank(F.col("rank"), F.lit(12), 5).alias("t")).toPandas()
    assert t.sort_values("id").t.tolist() == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 5, 5]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(size=2001)
    vals[::7] = 0.5  # ties
    pdf = pd.DataFrame({"id": np.arange(len(vals)), "x": vals, "g": np.arange(len(vals)) % 2})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.5, 0.7, 0.9, 1.0]
    got = exact_quantiles(df, "x", probs, rows_per_bucket=100).toPandas().sort_values("prob")
    assert np.allclose(got.value.to_numpy(), np.quantile(vals, probs), rtol=0, atol=1e-12)
    grp = exact_quantiles(df, "x", [0.5], group_cols=["g"], rows_per_bucket=100).toPandas()
    for g in (0, 1):
        assert abs(grp[grp.g == g].value.iloc[0] - np.median(vals[pdf.g == g])) < 1e-12


def test_exact_quantiles_empty(spark):
    df = spark.createDataFrame([(1, None)], "id long, x double")
    got = exact_quantiles(df, "x", [0.5]).collect()
    assert len(got) == 1 and got[0]["value"] is None


@pytest.mark.parametrize("tie", [None, "id"])
def test_value_held_by_two_thirds_is_split(spark, tie):
    """One value in 2/3 of the rows, three distinct values: no bucket holds it
    whole, with or without an id."""
    from cartlift.operators import ranking
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, 7.0).otherwise(F.col("id") % 2).alias("v"))
    placed = ranking._placed(df, [("v", False)], tie, (), None, 1000)
    most = placed.groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert placed.select("_bucket").distinct().count() >= 25 and most < 3000
    got = exact_quantiles(df, "v", [0.1, 0.2, 0.5, 0.9], rows_per_bucket=1000).orderBy("prob").collect()
    ref = np.quantile(df.toPandas().v, [0.1, 0.2, 0.5, 0.9])
    assert np.allclose([r["value"] for r in got], ref)


def test_quantiles_count_values_before_sorting(spark):
    """A hot value reaches the range shuffle once per group, not once per row."""
    df = spark.range(50_000).select(F.lit("g").alias("g"), F.lit(1.5).alias("v"))
    got = exact_quantiles(df, "v", [0.5], group_cols=["g"]).collect()
    assert [(r["g"], r["prob"], r["value"]) for r in got] == [("g", 0.5, 1.5)]


def test_thousand_buckets(spark):
    df = _frame(spark, n=4000)
    got = global_rank(df, [("v", True)], tie_col="id", rows_per_bucket=4)
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy(F.col("v").desc(), "id")))
    assert got.join(ref, "id").where(F.col("rank") != F.col("rn")).count() == 0


def test_small_inputs_take_several_buckets(spark):
    from cartlift.operators import ranking
    assert ranking.choose_buckets(10, 8) == 8 and ranking.choose_buckets(10_000_000_000, 8) == 10_000
    placed = ranking._placed(_frame(spark, n=500), [("v", False)], "id", (), None, ranking.ROWS_PER_BUCKET)
    assert placed.select("_bucket").distinct().count() > 1
    assert global_rank(spark.createDataFrame([], "id long, v double"), [("v", False)], tie_col="id").count() == 0


def test_ntile_matches_duckdb_for_all_small_sizes(spark):
    import duckdb

    from cartlift.operators.ranking import ntile_from_rank
    rows = [(n, r) for n in range(1, 201) for r in range(1, n + 1)]
    got = {(x.n, x.r): x.t for x in spark.createDataFrame(rows, "n long, r long")
           .select("n", "r", ntile_from_rank(F.col("r"), F.col("n"), 5).alias("t")).collect()}
    want = duckdb.sql("""select n, r, ntile(5) over (partition by n order by r) t
                         from (select unnest(range(1, 201)) n), lateral (select unnest(range(1, n + 1)) r)""").fetchall()
    assert got == {(n, r): t for n, r, t in want}


def test_readouts_of_all_scores_run_at_the_same_time(spark, monkeypatch):
    """The curves of both scores wait for each other here: one after the other they would never meet."""
    from threading import Barrier
    from cartlift.operators import curves
    scored = spark.range(400).select(
        F.col("id").alias("client_id"), (F.col("id") % 2).cast("int").alias("treatment_flg"), (F.col("id") % 3 == 0).cast("int").alias("target"),
        (F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    one_by_one = [tuple(curves.learner_evaluation(scored, (c,)).first()) for c in ("a", "b")]
    auc, meet = curves.normalized_auc, Barrier(4)

    def waits(*args, **kw):
        meet.wait(60)
        return auc(*args, **kw)

    monkeypatch.setattr(curves, "normalized_auc", waits)
    assert [tuple(r) for r in curves.learner_evaluation(scored, ("a", "b")).collect()] == one_by_one


def test_running_sums_of_many_rows_are_dealt_by_their_number(spark):
    """Spark merges the buckets of the window by compressed bytes, which grew to
    12 million rows a task; above a bucket's rows they are dealt by number."""
    n = 20_000
    df = spark.range(n).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 7919 % n).alias("v"))

    def sums(rows_per_bucket):
        return global_cumsum(df, [("v", False)], {"upto": F.lit(1)}, tie_col="v", group_cols=["g"],
                             rows_per_bucket=rows_per_bucket)

    many, few = sums(1000), sums(n)
    held = [r["count"] for r in many.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) >= 12 and max(held) <= 6000
    assert {tuple(r) for r in many.collect()} == {tuple(r) for r in few.collect()}
    assert {(r["g"], r["upto"]) for r in many.groupBy("g").agg(F.max("upto").alias("upto")).collect()} == {
        ("0", 6667), ("1", 6667), ("2", 6666)}
    plain = sorted(r["v"] for r in df.where("g = '1'").collect())
    assert exact_quantiles(df, "v", [0.5], ["g"], rows_per_bucket=1000).where("g = '1'").first()["value"] == plain[3333]
