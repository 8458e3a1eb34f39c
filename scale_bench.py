"""Scale check: the pipeline on the sf tables replicated R times.

Each replica offsets order and customer keys, so the customer count, the
purchase lines and the experiment population all grow R-fold (sf0.1 x 12 is
about 6.6M purchase lines, the size of a 30% sample of the original data).
The replicated tables are written to a scratch folder (argument 2, created
fresh by the caller); prints one JSON line.

usage: python scale_bench.py <scratch_dir> [R] [sf_dir] [features]
With the fourth argument ``features`` only the purchase-grain work runs (the
customer feature table and cohort retention), e.g. at R=100 (~55M lines,
more than the original full data).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from cartlift.config import AnalysisConfig  # noqa: E402
from cartlift.plans.context import GENDER_CATEGORIES  # noqa: E402
from cartlift.plans.pipeline import timed_run  # noqa: E402
from cartlift.session import build_session, ensure_checkpoint_dir  # noqa: E402
from cartlift.sources.fixtures import fixture_tables  # noqa: E402


def replicate(spark, src: str, dst: str, r: int, files: int = 16) -> None:
    """Write R offset copies of customer/orders/lineitem as ``files`` Parquet
    files each (a multi-file layout, as a large table would have)."""
    read = lambda n: spark.read.parquet(f"{src}/{n}.parquet")
    ok = read("orders").agg(F.max("o_orderkey")).first()[0] + 1
    ck = read("customer").agg(F.max("c_custkey")).first()[0] + 1
    rep = F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("_r")
    (read("customer").select("*", rep).withColumn("c_custkey", F.col("c_custkey") + F.col("_r") * ck)
     .drop("_r").repartition(files).write.mode("overwrite").parquet(f"{dst}/customer.parquet"))
    (read("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", rep)
     .withColumn("o_orderkey", F.col("o_orderkey") + F.col("_r") * ok)
     .withColumn("o_custkey", F.col("o_custkey") + F.col("_r") * ck)
     .drop("_r").repartition(files).write.mode("overwrite").parquet(f"{dst}/orders.parquet"))
    (read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", rep)
     .withColumn("l_orderkey", F.col("l_orderkey") + F.col("_r") * ok)
     .drop("_r").repartition(files).write.mode("overwrite").parquet(f"{dst}/lineitem.parquet"))


def main() -> None:
    scratch = sys.argv[1]
    r = int(sys.argv[2]) if len(sys.argv) > 2 else 12
    src = sys.argv[3] if len(sys.argv) > 3 else "/root/testdata/sf0.1"
    parallel = int(os.environ.get("BENCH_PARALLEL", "6"))
    land = {"0": False, "1": "parquet", "parquet": "parquet", "cache": "cache"}[os.environ.get("BENCH_LAND", "0")]
    spark = build_session("local[8]", shuffle_partitions=32, driver_memory="20g")
    ensure_checkpoint_dir(spark)
    data = f"{scratch}/data"
    t = time.perf_counter()
    if not all(os.path.exists(f"{data}/{n}.parquet/_SUCCESS") for n in ("customer", "orders", "lineitem")):
        replicate(spark, src, data, r)
    gen = time.perf_counter() - t
    tables = fixture_tables(spark, data)
    lines = tables["purchases"].count()
    if len(sys.argv) > 4 and sys.argv[4] == "features":
        if os.environ.get("BENCH_LAND", "0") == "cache":
            from pyspark import StorageLevel
            tables = {k: v.persist(StorageLevel.MEMORY_AND_DISK) for k, v in tables.items()}
        from cartlift.operators.features import customer_features
        from cartlift.operators.product import cohort_retention
        from cartlift.session import materialize
        t0 = time.perf_counter()
        feats = materialize(customer_features(tables["train"], tables["clients"], tables["purchases"],
                                              gender_cats=GENDER_CATEGORIES))
        t1 = time.perf_counter()
        cohort_retention(tables["purchases"]).write.format("noop").mode("overwrite").save()
        t2 = time.perf_counter()
        print(json.dumps({"metric": "purchase_grain_wall_replicated", "value": round(t2 - t0, 3), "unit": "sec",
                          "land_sources": os.environ.get("BENCH_LAND", "0"),
                          "replicas": r, "purchase_lines": lines, "customers": feats.count(),
                          "generate_sec": round(gen, 1),
                          "queries": {"customer_features": round(t1 - t0, 2), "cohort_retention": round(t2 - t1, 2)}}))
        spark.stop()
        return
    jobs: dict[str, int] = {}
    t0 = time.perf_counter()
    times = timed_run(spark, tables, AnalysisConfig.fixture(), jobs=jobs, gender_cats=GENDER_CATEGORIES,
                      parallel=parallel, land_sources=land)
    total = time.perf_counter() - t0
    print(json.dumps({"metric": "e2e_pipeline_wall_replicated", "value": round(total, 3), "unit": "sec",
                      "replicas": r, "land_sources": land, "driver_threads": parallel, "purchase_lines": lines, "generate_sec": round(gen, 1),
                      "queries": {k: round(v, 2) for k, v in times.items()}, "spark_jobs": sum(jobs.values())}))
    spark.stop()


if __name__ == "__main__":
    main()
