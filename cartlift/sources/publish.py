"""Dated, atomic publishing of result tables (O-07).

A run writes its tables to folders of its own, ``<root>/<table>/run=<date>-<id>``,
and then one small manifest that names them.  Only the manifest makes a run
visible: readers take the newest complete one, so a run that fails between two
tables leaves the former run whole, and publishing a date again replaces that
date's run at once for all tables.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "_runs"


def publish_run(spark: SparkSession, tables: dict[str, Callable[[], DataFrame] | DataFrame], root: str, run_date: str) -> str:
    """Write all tables, then the manifest; returns the run's id."""
    root, run = root.rstrip("/"), f"{run_date}-{uuid.uuid4().hex[:12]}"
    rows = []
    for name, table in tables.items():
        path = f"{name}/run={run}"
        (table() if callable(table) else table).write.parquet(f"{root}/{path}")
        rows.append((run_date, run, time.time_ns(), name, path))
    (spark.createDataFrame(rows, "run_date string, run string, published long, table string, path string")
     .coalesce(1).write.parquet(f"{root}/{RUNS}/{run}"))
    return run


def runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_date, run, published, table, path) of all complete runs."""
    return spark.read.parquet(f"{root.rstrip('/')}/{RUNS}/*")


def read_published(spark: SparkSession, root: str, table: str, run_date: str | None = None) -> DataFrame:
    """A table of the newest complete run (of a date, if given; the latest publication of it counts)."""
    known = runs(spark, root)
    if run_date is not None:
        known = known.where(F.col("run_date") == run_date)
    newest = known.groupBy("run").agg(F.max(F.struct("run_date", "published")).alias("at")).orderBy(F.desc("at")).first()
    if newest is None:
        raise LookupError(f"no complete run under {root}" + (f" for {run_date}" if run_date else ""))
    row = known.where((F.col("run") == newest["run"]) & (F.col("table") == table)).first()
    if row is None:
        raise LookupError(f"run {newest['run']} has no table {table}")
    return spark.read.parquet(f"{root.rstrip('/')}/{row['path']}")
