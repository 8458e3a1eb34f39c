"""Fixture views: the loyalty tables derived from the driver's star schema.

The test data carries no loyalty tables, so ``purchases``, ``clients`` and
``train`` are *derived* from ``lineitem``, ``orders`` and ``customer`` (see
FIXTURES.md section 3).  Every row of those base tables feeds the views, so
all work grows with the data.  The same derivation is written in DuckDB SQL
(:data:`DUCK_VIEWS`) and prepended as CTEs to every oracle query.

Fixed values of the mapping (must equal the oracle text below):
  campaign date 2001-01-01; outcome window [2001-01-01, 2001-06-30);
  experiment population: keyed uniform u(c_custkey, 'train') < 0.8;
  arm: u(c_custkey, 'arm') < 0.5; planted lift: u(c_custkey, 'lift') below
  0.30 when the customer has 10 or more pre-campaign orders, else below 0.05.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlift.functions.hashing import duck_keyed_uniform, keyed_uniform

CAMPAIGN_DATE = "2001-01-01"
OUTCOME_END = "2001-06-30"
TRAIN_SHARE = 0.8


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ROWS_PER_TASK, LEFT_TO_SPARK = 400_000, 3_000_000


def join_parts(rows: int) -> int | None:
    """Partitions of the join of ``rows`` lines; None leaves few rows to Spark.

    Spark merges partitions by their compressed bytes.  Lines compress well, so
    a task got some 3 million of them, and its memory (the sorts of the join and
    four hash maps of the transaction rollup, which runs in the same task) was
    over 1 GB.  Dealt by number it stays the same however many lines there are.
    """
    return -(-rows // ROWS_PER_TASK) if rows > LEFT_TO_SPARK else None


def line_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """:func:`join_parts` of the lines, from the row counts of the files."""
    return join_parts(_read(spark, sf_dir, "lineitem").count())


def fixture_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = (_read(spark, sf_dir, "orders")
              .where(F.col("o_orderdate") < F.expr(f"timestamp_ntz'{CAMPAIGN_DATE}'"))
              .select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"))
    lines = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    parts = line_parts(spark, sf_dir)
    if parts:
        lines = lines.repartition(parts, "l_orderkey")
        # the orders of a partition are few and are hashed; lines need no sort then
        orders = orders.repartition(parts, "o_orderkey").hint("shuffle_hash")
    j = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    k = F.col("o_orderkey")
    return j.select(
        F.col("o_custkey").alias("client_id"),
        k.alias("transaction_id"),
        F.timestamp_add("SECOND", (k % 86400).cast("int"), F.col("o_orderdate")).alias("transaction_datetime"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("store_id"),
        F.col("o_totalprice").alias("purchase_sum"),
        (F.col("o_totalprice") * F.lit(0.01)).alias("regular_points_received"),
        F.when(k % 5 == 0, -(k % 50)).otherwise(F.lit(0)).cast("double").alias("regular_points_spent"),
        F.when(k % 7 == 0, F.lit(10)).otherwise(F.lit(0)).cast("double").alias("express_points_received"),
        F.when(k % 11 == 0, F.lit(-5)).otherwise(F.lit(0)).cast("double").alias("express_points_spent"),
        F.col("l_extendedprice").alias("trn_sum_from_iss"),
        F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).alias("trn_sum_from_red"),
    )


def fixture_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    base = F.expr("timestamp_ntz'1994-01-01'")
    issue_days = (c * 37 % 365).cast("int")
    return _read(spark, sf_dir, "customer").select(
        c.alias("client_id"),
        F.when(c % 97 == 0, F.lit(None)).otherwise((18 + c % 70).cast("double")).alias("age"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "M")
         .when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), "F")
         .when(F.col("c_mktsegment") == "HOUSEHOLD", "U").alias("gender"),
        F.timestamp_add("SECOND", (c % 86400).cast("int"),
                        F.timestamp_add("DAY", issue_days, base)).alias("first_issue_date"),
        F.when(c % 3 != 0,
               F.timestamp_add("SECOND", (c % 1000).cast("int"),
                               F.timestamp_add("DAY", (c * 37 % 365 + c * 53 % 3000).cast("int"), base))
               ).alias("first_redeem_date"),
    )


def client_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """:func:`join_parts` of the orders or the clients, whichever are more."""
    return join_parts(max(_read(spark, sf_dir, n).count() for n in ("orders", "customer")))


def dealt_history(orders: DataFrame, before: Column, after: Column, parts: int) -> DataFrame:
    """Orders ``before`` (``n``) and any ``after`` (``organic``) per client, in ``parts`` partitions.

    A client's orders are counted in slices first, so no task reads all of a hot client's.
    """
    sliced = (orders.select(F.col("o_custkey").alias("client_id"),
                            F.pmod(F.xxhash64("o_orderkey"), F.lit(16)).alias("slice"),
                            before.alias("before"), after.alias("after"))
              .repartition(parts, "client_id", "slice").groupBy("client_id", "slice")
              .agg(F.count_if("before").alias("n"), F.bool_or("after").alias("organic")))
    return (sliced.repartition(parts, "client_id").groupBy("client_id")
            .agg(F.sum("n").alias("n"), F.bool_or("organic").alias("organic")))


def fixture_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    campaign = F.expr(f"timestamp_ntz'{CAMPAIGN_DATE}'")
    before = F.col("o_orderdate") < campaign
    after = ((F.col("o_orderdate") >= campaign)
             & (F.col("o_orderdate") < F.expr(f"timestamp_ntz'{OUTCOME_END}'")))
    cust = (_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"))
            .where(keyed_uniform("client_id", "train") < F.lit(TRAIN_SHARE)))
    parts = client_parts(spark, sf_dir)
    if parts:
        # by bytes Spark put all clients of 9 million orders into one task
        known = cust.repartition(parts, "client_id").join(
            dealt_history(orders, before, after, parts).hint("shuffle_hash"), "client_id", "left")
    else:
        history = (orders.where(before)
                   .groupBy(F.col("o_custkey").alias("client_id")).agg(F.count(F.lit(1)).alias("n")))
        post = (orders.where(after).select(F.col("o_custkey").alias("client_id")).distinct()
                .withColumn("organic", F.lit(True)))
        known = cust.join(history, "client_id", "left").join(post, "client_id", "left")
    a = (known
         .select("client_id",
                 F.when(keyed_uniform("client_id", "arm") < F.lit(0.5), 1).otherwise(0).alias("treatment_flg"),
                 keyed_uniform("client_id", "lift").alias("ul"), "n",
                 F.coalesce(F.col("organic"), F.lit(False)).alias("organic")))
    lift_p = F.when(F.col("n") >= 10, F.lit(0.30)).otherwise(F.lit(0.05))
    target = F.when(F.col("organic") | ((F.col("treatment_flg") == 1) & (F.col("ul") < lift_p)), 1).otherwise(0)
    return a.select("client_id", target.cast("int").alias("target"),
                    F.col("treatment_flg").cast("int").alias("treatment_flg"))


def fixture_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"purchases": fixture_purchases(spark, sf_dir),
            "clients": fixture_clients(spark, sf_dir),
            "train": fixture_train(spark, sf_dir)}


DUCK_VIEWS = f"""
purchases AS (
 select o.o_custkey client_id, o.o_orderkey transaction_id,
  o.o_orderdate + to_seconds(o.o_orderkey % 86400) transaction_datetime,
  l.l_partkey product_id, l.l_suppkey store_id, o.o_totalprice purchase_sum,
  o.o_totalprice*cast(0.01 as double) regular_points_received,
  cast(case when o.o_orderkey%5=0 then -(o.o_orderkey%50) else 0 end as double) regular_points_spent,
  cast(case when o.o_orderkey%7=0 then 10 else 0 end as double) express_points_received,
  cast(case when o.o_orderkey%11=0 then -5 else 0 end as double) express_points_spent,
  l.l_extendedprice trn_sum_from_iss, case when l.l_returnflag='R' then l.l_extendedprice end trn_sum_from_red
 from lineitem l join orders o on o.o_orderkey=l.l_orderkey where o.o_orderdate < timestamp '{CAMPAIGN_DATE}'),
clients AS (
 select c_custkey client_id, case when c_custkey%97=0 then null else cast(18+c_custkey%70 as double) end age,
  case c_mktsegment when 'AUTOMOBILE' then 'M' when 'BUILDING' then 'F' when 'FURNITURE' then 'F' when 'HOUSEHOLD' then 'U' end gender,
  timestamp '1994-01-01' + to_days(cast(c_custkey*37%365 as int)) + to_seconds(c_custkey%86400) first_issue_date,
  case when c_custkey%3<>0 then timestamp '1994-01-01' + to_days(cast(c_custkey*37%365 + c_custkey*53%3000 as int)) + to_seconds(c_custkey%1000) end first_redeem_date
 from customer),
train AS (
 with h as (select o_custkey client_id, count(*) n from orders where o_orderdate < timestamp '{CAMPAIGN_DATE}' group by o_custkey),
  po as (select distinct o_custkey client_id from orders where o_orderdate >= timestamp '{CAMPAIGN_DATE}' and o_orderdate < timestamp '{OUTCOME_END}'),
  a as (select c_custkey client_id,
          case when {duck_keyed_uniform('c_custkey', 'arm')} < cast(0.5 as double) then 1 else 0 end treatment_flg,
          {duck_keyed_uniform('c_custkey', 'lift')} ul, h.n, po.client_id is not null organic
        from customer left join h on h.client_id=c_custkey left join po on po.client_id=c_custkey
        where {duck_keyed_uniform('c_custkey', 'train')} < cast({TRAIN_SHARE} as double))
 select client_id,
  cast(case when organic or (treatment_flg=1 and ul < case when n>=10 then cast(0.30 as double) else cast(0.05 as double) end) then 1 else 0 end as integer) target,
  cast(treatment_flg as integer) treatment_flg
 from a)"""
