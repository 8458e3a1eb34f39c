"""Raw loyalty tables: explicit schemas, ingest normalisation, sampling, sinks.

Source layout (three tables joined on ``client_id``):

* ``purchases`` - one row per product line of a transaction; the
  transaction-level values (sum, points, time) repeat on every line.
* ``clients`` - one row per customer (age, gender, card dates).
* ``train`` - experiment customers with arm ``treatment_flg`` and outcome
  ``target``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlift.functions.columns import nan_to_null
from cartlift.functions.hashing import keyed_uniform

ID, ARM, OUTCOME = "client_id", "treatment_flg", "target"

PURCHASE_AMOUNTS = ("purchase_sum", "regular_points_received", "regular_points_spent",
                    "express_points_received", "express_points_spent",
                    "trn_sum_from_iss", "trn_sum_from_red")

PURCHASES_CSV_SCHEMA = T.StructType([
    T.StructField("client_id", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("transaction_datetime", T.StringType()),
    T.StructField("regular_points_received", T.DoubleType()),
    T.StructField("express_points_received", T.DoubleType()),
    T.StructField("regular_points_spent", T.DoubleType()),
    T.StructField("express_points_spent", T.DoubleType()),
    T.StructField("purchase_sum", T.DoubleType()),
    T.StructField("store_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("product_quantity", T.DoubleType()),
    T.StructField("trn_sum_from_iss", T.DoubleType()),
    T.StructField("trn_sum_from_red", T.DoubleType()),
])

CLIENTS_CSV_SCHEMA = T.StructType([
    T.StructField("client_id", T.StringType()),
    T.StructField("first_issue_date", T.StringType()),
    T.StructField("first_redeem_date", T.StringType()),
    T.StructField("age", T.DoubleType()),
    T.StructField("gender", T.StringType()),
])

TRAIN_CSV_SCHEMA = T.StructType([
    T.StructField("client_id", T.StringType()),
    T.StructField("treatment_flg", T.IntegerType()),
    T.StructField("target", T.IntegerType()),
])


def parse_timestamp(col: Column | str) -> Column:
    """Text to TIMESTAMP_NTZ as it is written, in whatever session zone;
    unparsable text becomes NULL (a plain cast would raise under ANSI mode)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("string").try_cast("timestamp_ntz")


def _timestamp_col(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.col(name)
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return F.col(name).cast("timestamp_ntz")
    return parse_timestamp(name)


def prepare_purchases(df: DataFrame) -> DataFrame:
    """Ingest normalisation: NTZ time, NaN amounts to NULL, no NULL keys."""
    cols = []
    for f in df.schema.fields:
        if f.name == "transaction_datetime":
            cols.append(_timestamp_col(df, f.name).alias(f.name))
        elif f.name in PURCHASE_AMOUNTS and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(nan_to_null(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols).where(F.col(ID).isNotNull())


def prepare_clients(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if f.name in ("first_issue_date", "first_redeem_date"):
            cols.append(_timestamp_col(df, f.name).alias(f.name))
        elif f.name == "age" and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(nan_to_null("age").alias("age"))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols).where(F.col(ID).isNotNull())


def prepare_train(df: DataFrame) -> DataFrame:
    return df.select(F.col(ID), F.col(OUTCOME).cast("int").alias(OUTCOME),
                     F.col(ARM).cast("int").alias(ARM)).where(F.col(ID).isNotNull())


def load_tables(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet"
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read ``train``, ``clients``, ``purchases`` (O-01/O-02).

    CSV is read with explicit schemas (no inference pass).  Gzip CSV is not
    splittable - land it once with :func:`land_as_parquet` and read that.
    """
    schemas = {"train": TRAIN_CSV_SCHEMA, "clients": CLIENTS_CSV_SCHEMA,
               "purchases": PURCHASES_CSV_SCHEMA}
    out = {}
    for name in ("train", "clients", "purchases"):
        reader = spark.read
        if fmt == "csv":
            reader = reader.schema(schemas[name]).option("header", "true").option("mode", "PERMISSIVE")
        out[name] = reader.format(fmt).load(paths[name])
    return (prepare_train(out["train"]), prepare_clients(out["clients"]),
            prepare_purchases(out["purchases"]))


def land_as_parquet(df: DataFrame, path: str, partitions: int, sort_cols: tuple[str, ...] = (ID,),
                    mode: str = "overwrite") -> None:
    """Rewrite a source as splittable Parquet.

    Round-robin repartitioning keeps files even when one customer owns a large
    share of the rows; sorting inside each file on ``client_id`` makes row-group
    statistics selective for customer-level lookups.
    """
    (df.repartition(partitions).sortWithinPartitions(*sort_cols)
       .write.mode(mode).parquet(path))


def sample_customers(train: DataFrame, frac: float | None, salt: str = "sample") -> DataFrame:
    """Keep a keyed-hash Bernoulli fraction of experiment customers (O-03).

    Unlike ``DataFrame.sample`` the selection is a function of ``client_id``
    alone, so it is stable under repartitioning and recomputation.
    """
    if frac is None or frac >= 1.0:
        return train
    return train.where(keyed_uniform(ID, salt) < F.lit(float(frac)))


def sampled_purchases(purchases: DataFrame, customers: DataFrame | None) -> DataFrame:
    """Purchases of the sampled customers only (O-04); no filter without a sample.

    A left-semi join; AQE turns it into a broadcast join at run time when the
    key side is measured small, and keeps the shuffle join otherwise.
    """
    if customers is None:
        return purchases
    return purchases.join(customers.select(ID), on=ID, how="left_semi")


def reference_time(purchases: DataFrame, as_of=None) -> DataFrame:
    """One-row frame ``ref_time`` = latest purchase time, or a fixed ``as_of`` (O-06)."""
    if as_of is not None:
        return purchases.sparkSession.range(1).select(
            F.lit(as_of).cast("timestamp_ntz").alias("ref_time"))
    return purchases.agg(F.max("transaction_datetime").alias("ref_time"))


def write_tables(tables: dict[str, DataFrame], root: str, mode: str = "overwrite",
                 partition_by: dict[str, list[str]] | None = None) -> None:
    """Write result tables as Parquet under ``root/<name>`` (O-07)."""
    partition_by = partition_by or {}
    for name, df in tables.items():
        w = df.write.mode(mode)
        if partition_by.get(name):
            w = w.partitionBy(*partition_by[name])
        w.parquet(f"{root.rstrip('/')}/{name}")
