import math

import pytest
from pyspark.sql import functions as F

from cartlift.config import AnalysisConfig
from cartlift.operators import product
from cartlift.operators.uplift import t_learner
from cartlift.sources import raw

PURCHASES_CSV = """client_id,transaction_id,transaction_datetime,regular_points_received,express_points_received,regular_points_spent,express_points_spent,purchase_sum,store_id,product_id,product_quantity,trn_sum_from_iss,trn_sum_from_red
a1,t1,2019-03-08 10:05:01,1.0,0.0,0.0,0.0,100.5,s1,p1,1.0,50.0,
a1,t1,2019-03-08 10:05:01,1.0,0.0,0.0,0.0,100.5,s1,p2,2.0,50.5,
a1,t2,not a date,0.5,0.0,-2.0,0.0,NaN,s2,p1,1.0,10.0,3.0
b2,t3,2019-04-01 09:00:00,0.0,0.0,0.0,0.0,20.0,s1,p3,1.0,20.0,
"""
CLIENTS_CSV = """client_id,first_issue_date,first_redeem_date,age,gender
a1,2017-08-05 15:40:48,2018-01-04 19:30:07,45,F
b2,2017-04-10 13:54:23,,72,U
"""
TRAIN_CSV = """client_id,treatment_flg,target
a1,0,1
b2,1,1
c3,1,0
"""


@pytest.fixture()
def csv_paths(tmp_path):
    paths = {}
    for name, body in (("purchases", PURCHASES_CSV), ("clients", CLIENTS_CSV), ("train", TRAIN_CSV)):
        p = tmp_path / f"{name}.csv"
        p.write_text(body)
        paths[name] = str(p)
    return paths


def test_load_csv_with_explicit_schema(spark, csv_paths):
    train, clients, purchases = raw.load_tables(spark, csv_paths, fmt="csv")
    assert train.count() == 3 and clients.count() == 2 and purchases.count() == 4
    assert dict(purchases.dtypes)["transaction_datetime"] == "timestamp_ntz"
    rows = purchases.where("transaction_id = 't2'").first()
    assert rows.transaction_datetime is None and rows.purchase_sum is None   # bad text, NaN -> NULL
    q = product.time_quality(purchases).first()
    assert (q.lines, q.lines_without_time, q.transactions_without_time) == (4, 1, 1)


def test_land_and_write_roundtrip(spark, csv_paths, tmp_path):
    _, _, purchases = raw.load_tables(spark, csv_paths, fmt="csv")
    raw.land_as_parquet(purchases, str(tmp_path / "landed"), partitions=2)
    back = spark.read.parquet(str(tmp_path / "landed"))
    assert back.count() == 4 and set(back.columns) == set(purchases.columns)
    out = {"cohorts": product.cohort_retention(back)}
    raw.write_tables(out, str(tmp_path / "results"), partition_by={"cohorts": ["cohort"]})
    got = spark.read.parquet(str(tmp_path / "results" / "cohorts"))
    assert got.count() == 2 and "retention" in got.columns


def test_sampling_is_keyed_and_semi_joined(spark, csv_paths):
    train, _, purchases = raw.load_tables(spark, csv_paths, fmt="csv")
    a = {r.client_id for r in raw.sample_customers(train, 0.5, "s").collect()}
    b = {r.client_id for r in raw.sample_customers(train.repartition(3), 0.5, "s").collect()}
    assert a == b                                       # stable under repartitioning
    kept = raw.sampled_purchases(purchases, raw.sample_customers(train, 0.5, "s"))
    assert {r.client_id for r in kept.collect()} <= a
    assert raw.sampled_purchases(purchases, None).count() == 4   # no sample -> no filter
    ref = raw.reference_time(purchases).first().ref_time
    assert str(ref) == "2019-04-01 09:00:00"


@pytest.mark.parametrize("learner", ["rf", "logistic"])
def test_pluggable_learners(spark, learner):
    from cartlift.plans.context import Context
    from cartlift.operators.features import feature_names
    c = Context(spark, "/root/testdata/sf0.001", AnalysisConfig.fixture().with_(learner=learner, learner_iters=5))
    s = c.segmented
    fc = feature_names(s)
    from cartlift.functions.hashing import keyed_uniform
    half = s.where(keyed_uniform("client_id", "fit") < 0.5)
    out = t_learner(half, s, fc, c.config).select("t_score").collect()
    assert len(out) == s.count() and all(-1.0 <= r.t_score <= 1.0 and not math.isnan(r.t_score) for r in out)


def test_pipeline_run_builds_every_output(spark):
    from cartlift.plans.pipeline import run
    from cartlift.sources.fixtures import fixture_tables
    out = run(spark, fixture_tables(spark, "/root/testdata/sf0.001"),
              AnalysisConfig.fixture().with_(learner_iters=5), gender_cats=("F", "M", "U"))
    assert {"customer_features", "launch_readout", "uplift_scores", "policy_value", "psi_drift"} <= set(out)
    assert out["launch_readout"].first().decision in ("LAUNCH", "HOLD")
    assert out["uplift_deciles"].count() == 10
    assert out["customer_features"].count() == 112


def test_run_from_paths_to_written_tables(spark, tmp_path):
    """Source files in, every result table out, no intermediate table left."""
    import os

    from cartlift.config import AnalysisConfig
    from cartlift.plans.pipeline import Run, run_from_paths
    from cartlift.session import ensure_checkpoint_dir
    from cartlift.sources.fixtures import fixture_tables
    from cartlift.sources.raw import sample_customers

    tables = fixture_tables(spark, "/root/testdata/sf0.01")
    paths = {}
    for name in ("train", "clients", "purchases"):
        paths[name] = str(tmp_path / name)
        tables[name].write.parquet(paths[name])
    folder = ensure_checkpoint_dir(spark).replace("file:", "") + "/tables"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    cfg = AnalysisConfig.fixture().with_(sample_frac=0.3, null_future_dates=True, approximate_breadth=True,
                                         approximate_medians=True, learner="logistic")
    out = str(tmp_path / "out")
    names = run_from_paths(spark, paths, out, cfg)
    assert set(names) == set(Run(spark, tables, cfg).outputs())
    got = {n: spark.read.parquet(f"{out}/{n}") for n in names}
    assert all(df.count() >= 1 for df in got.values())
    kept = sample_customers(tables["train"], 0.3).count()
    assert got["customer_features"].count() == kept < tables["train"].count()
    assert {r["feature"] for r in got["psi_drift"].collect()} == {"t_score", *cfg.key_features}
    assert [r["score_col"] for r in got["learner_evaluation"].orderBy("score_col").collect()] == ["s_score", "t_score"]
    assert set(os.listdir(folder)) == before


def test_text_times_keep_their_wall_clock(spark):
    """Text times in a daylight-saving gap stay as written; junk becomes NULL."""
    from cartlift.sources.raw import parse_timestamp
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([("2023-03-12 02:30:00",), ("2019-01-07 00:00:01",), ("soon",), (None,)], "t string")
        got = [r[0] for r in df.select(parse_timestamp("t").cast("string")).collect()]
        assert got == ["2023-03-12 02:30:00", "2019-01-07 00:00:01", None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_cluster_session_leaves_shuffle_partitions_alone(spark):
    from cartlift.session import build_session
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        assert build_session(master=None).conf.get("spark.sql.shuffle.partitions") == "37"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_categories_come_from_the_joined_customers(spark):
    """A category found only outside the experiment adds no column."""
    from cartlift.operators.features import gender_categories
    train = spark.createDataFrame([("c1", 1, 0), ("c2", 0, 1)], "client_id string, target int, treatment_flg int")
    clients = spark.createDataFrame([("c1", "M"), ("c2", "F"), ("c3", "A"), ("c1x", None)], "client_id string, gender string")
    assert gender_categories(train, clients) == ["F", "M"]


def test_lines_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """More lines than a task should hold: the join's partitions go by the row
    count, whatever Spark makes of the bytes; the rows stay the same."""
    from cartlift.sources import fixtures
    orders = spark.range(1, 3001).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 40).alias("o_custkey"),
        F.expr("timestamp_ntz'1999-05-05'").alias("o_orderdate"), (F.col("id") * 1.5).cast("double").alias("o_totalprice"))
    lines = spark.range(9000).select(
        F.when(F.col("id") % 50 != 0, F.col("id") % 3000 + 1).alias("l_orderkey"), (F.col("id") % 7).alias("l_partkey"),
        (F.col("id") % 3).alias("l_suppkey"), F.lit(2.0).alias("l_extendedprice"), F.lit("R").alias("l_returnflag"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))

    def held(df):
        return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())

    few = fixtures.fixture_purchases(spark, str(tmp_path))
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 300)
    monkeypatch.setattr(fixtures, "LEFT_TO_SPARK", 3000)
    many = fixtures.fixture_purchases(spark, str(tmp_path))
    assert many.count() == 8820 and many.exceptAll(few).count() == few.exceptAll(many).count() == 0
    assert len(held(many)) >= 25 and held(many)[-1] <= 600
    from cartlift.operators.features import transaction_rollup
    assert held(transaction_rollup(many))[-1] <= 200  # the rollup runs in the same tasks
    assert fixtures.join_parts(3000) is None and fixtures.join_parts(3001) == 11


def test_distinct_cells_are_dealt_by_their_number(spark):
    """Counts of distinct products and stores are the same whether Spark merges
    the partitions or they go by number, with NULLs, repeats and a client without values."""
    from cartlift.operators.features import breadth_cells, customer_breadth
    rows = [(i % 31 or None, i % 500, f"p{i % 17}" if i % 5 else None, i % 3 if i % 4 else None) for i in range(4000)]
    rows += [(77, 1, None, None), (77, 2, None, None), (78, None, "p1", 5), (78, None, "p1", 5)]
    lines = spark.createDataFrame(rows, "client_id long, transaction_id long, product_id string, store_id long")
    plain, dealt = customer_breadth(lines), customer_breadth(lines, parts=16)
    assert dealt.schema == plain.schema and dealt.count() == 33
    assert {tuple(r) for r in dealt.collect()} == {tuple(r) for r in plain.collect()}
    cells = breadth_cells(lines, 16)
    held = [r["count"] for r in cells.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) >= 12 and max(held) < cells.count() / 4


def test_many_lines_give_the_same_features_in_dealt_parts(spark, monkeypatch):
    """Above the bound the customer table's cells and experiment customers are
    dealt by the number of lines; its rows stay the same."""
    from cartlift.plans.context import Context
    from cartlift.plans.present import present
    from cartlift.sources import fixtures
    few = Context(spark, "/root/testdata/sf0.001").features_lazy()
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 400)
    monkeypatch.setattr(fixtures, "LEFT_TO_SPARK", 3000)
    c = Context(spark, "/root/testdata/sf0.001")
    many = c.features_lazy()
    parts = fixtures.join_parts(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count())
    assert c.line_parts == parts >= 10
    plan = many._jdf.queryExecution().toString()
    assert "RepartitionByExpression [client_id" in plan and plan.count(f", {parts}\n") >= 2
    assert many.schema == few.schema
    assert {tuple(r) for r in present(many).collect()} == {tuple(r) for r in present(few).collect()}


def test_many_lines_are_read_for_the_rollup_and_the_breadth_only(spark, tmp_path, monkeypatch):
    """The reference time of a dealt customer table comes from the written rollup,
    without a pass of its own over the lines; lines meet hashed orders, unsorted.
    Null and repeated keys, null times and clients without lines stay as they were."""
    import datetime as dt

    from cartlift.operators import features as feat
    from cartlift.sources import fixtures
    orders = [(k if k % 41 else None, k % 60 if k % 13 else None, 10.0 + k,
               dt.datetime(1996, 1, 1) + dt.timedelta(days=k) if k % 17 else None) for k in range(1, 900)]
    orders += [(5, 7, 3.0, dt.datetime(1999, 5, 5)), (5, 7, 3.0, dt.datetime(1999, 5, 5))]
    lines = [(i % 950 if i % 29 else None, i % 23, i % 5 if i % 3 else None, 1.0 + i, "R" if i % 4 else "N") for i in range(3600)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    train = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(70)], "client_id long, target int, treatment_flg int")
    clients = spark.createDataFrame([(i, float(i), "F" if i % 2 else None) for i in range(65)], "client_id long, age double, gender string")

    def rows(df):
        return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())

    few = fixtures.fixture_purchases(spark, str(tmp_path))
    want = rows(feat.customer_features(train, clients, few))
    fixed = rows(feat.customer_features(train, clients, few, as_of=dt.datetime(2000, 1, 1)))
    none = rows(feat.customer_features(train, clients, few.where("false")))
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 300)
    monkeypatch.setattr(fixtures, "LEFT_TO_SPARK", 3000)
    many = fixtures.fixture_purchases(spark, str(tmp_path))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert rows(many) == rows(few)

    def no_pass(*a):
        raise AssertionError("the lines were read for the reference time")
    monkeypatch.setattr(feat, "reference_time_value", no_pass)
    assert rows(feat.customer_features(train, clients, many, parts=12)) == want
    assert rows(feat.customer_features(train, clients, many, as_of=dt.datetime(2000, 1, 1), parts=12)) == fixed
    assert rows(feat.customer_features(train, clients, many.where("false"), parts=12)) == none


def test_many_orders_give_the_same_train_in_dealt_parts(spark, tmp_path, monkeypatch):
    """Above the bound clients and their orders are dealt by number, not merged by
    bytes; null, repeated and hot keys, null times and clients without orders stay as they were."""
    import datetime as dt

    from cartlift.sources import fixtures
    start = dt.datetime(2000, 9, 1)
    orders = [(k if k % 41 else None, 7 if k % 3 == 0 else k % 900 if k % 13 else None,
               start + dt.timedelta(days=k % 400) if k % 17 else None) for k in range(6000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    clients = [(k if k % 97 else None,) for k in range(1200)] + [(5,), (5,)]
    spark.createDataFrame(clients, "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")

    def held(df):
        return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())

    few = fixtures.fixture_train(spark, str(tmp_path))
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 300)
    monkeypatch.setattr(fixtures, "LEFT_TO_SPARK", 3000)
    many = fixtures.fixture_train(spark, str(tmp_path))
    assert fixtures.client_parts(spark, str(tmp_path)) == 20
    assert many.schema == few.schema and sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    assert few.where("target = 1").count() and few.where("target = 0").count()
    assert len(held(many)) >= 15 and held(many)[-1] <= few.count() / 8
    # a client with a third of the orders is counted in slices
    before = F.col("o_orderdate") < F.lit(dt.datetime(2001, 1, 1)).cast("timestamp_ntz")
    plan = fixtures.dealt_history(spark.read.parquet(f"{tmp_path}/orders.parquet"), before, ~before, 20)._jdf.queryExecution().toString()
    assert "RepartitionByExpression [client_id" in plan and "slice" in plan
