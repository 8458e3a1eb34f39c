"""Global order without a single partition, one path for every size.

``Window.orderBy`` without ``partitionBy`` moves every row into one task.
Here rows are dealt by Spark's range partitioner instead:

1. ``repartitionByRange`` on (groups, order, tie key) into B buckets, B from
   the row count and the session's parallelism; each bucket is sorted;
2. bucket number and position in the bucket are written with the rows to the
   shared folder, so a recomputation can't see other bucket borders;
3. the rows of each (group, bucket) are counted; these counts, at most B + G
   rows, are summed up in order and joined back;
4. rank = rows of the group in earlier buckets + position in the bucket.
   Running sums add one window over (group, bucket), ordered by position;
   many rows are dealt to it by their number (Spark would merge buckets by bytes).

The tie key (the entity id) is part of the range key, so a value that a third
of all rows hold is split like any other.  Quantiles first aggregate to
(group, value, count), combined map-side, and so never hold a repeated value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlift.session import materialize

ROWS_PER_BUCKET = 1_000_000
WINDOW_SPREAD = 4  # window partitions for each full bucket: buckets are hashed to them, few then meet
POSITION_BITS = (1 << 33) - 1  # monotonically_increasing_id: position in the partition

OrderSpec = Sequence[tuple[str, bool]]  # (column, descending)


def _sort_cols(cols: OrderSpec) -> list[Column]:
    return [F.col(c).desc() if d else F.col(c).asc() for c, d in cols]


def choose_buckets(n: int, parallelism: int = 1, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """At least one bucket for each core, and none of more than about ``rows_per_bucket`` rows."""
    return max(1, parallelism, math.ceil(n / max(rows_per_bucket, 1)))


def _placed(df: DataFrame, order: OrderSpec, tie_col: str | Column | None, group_cols: Sequence[str],
            n: int | None, rows_per_bucket: int) -> DataFrame:
    """Rows with ``_bucket`` and ``_pos`` (position in the sorted bucket), written once."""
    tie = (F.monotonically_increasing_id() if tie_col is None
           else F.col(tie_col) if isinstance(tie_col, str) else tie_col)
    df = df.withColumn("_tie", tie)
    if n is None:
        n = df.count()
    keys = _sort_cols([*[(g, False) for g in group_cols], *order, ("_tie", False)])
    buckets = choose_buckets(n, df.sparkSession.sparkContext.defaultParallelism, rows_per_bucket)
    return materialize(df.repartitionByRange(buckets, *keys).sortWithinPartitions(*keys).drop("_tie")
                       .withColumn("_bucket", F.spark_partition_id())
                       .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(POSITION_BITS))), "ranked")


def _offsets(placed: DataFrame, group_cols: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Per (group, bucket): first position, and ``_o_<name>``, the totals of
    the group's earlier buckets (at most B + G rows reach the driver)."""
    aggs = [F.min("_pos").alias("_first"), *[F.sum(c).alias(f"_t_{k}") for k, c in totals.items()]]
    small = placed.groupBy(*group_cols, "_bucket").agg(*aggs)
    rows = sorted(small.collect(), key=lambda r: (tuple(r[g] for g in group_cols), r["_bucket"]))
    real = {k: isinstance(small.schema[f"_t_{k}"].dataType, (T.DoubleType, T.FloatType)) for k in totals}
    out, run, last = [], {}, None
    for r in rows:
        group = tuple(r[g] for g in group_cols)
        if group != last:
            run, last = {k: 0.0 if real[k] else 0 for k in totals}, group
        out.append((*group, r["_bucket"], r["_first"], *[run[k] for k in totals]))
        for k in totals:
            add = r[f"_t_{k}"] or 0
            run[k] += float(add) if real[k] else int(add)
    schema = T.StructType([*[placed.schema[g] for g in group_cols], T.StructField("_bucket", T.IntegerType()),
                           T.StructField("_first", T.LongType()),
                           *[T.StructField(f"_o_{k}", T.DoubleType() if real[k] else T.LongType()) for k in totals]])
    return placed.sparkSession.createDataFrame(out, schema)


def global_cumsum(df: DataFrame, order: OrderSpec, measures: dict[str, Column],
                  tie_col: str | Column | None = None, group_cols: Sequence[str] = (),
                  n: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Inclusive running sums of ``measures`` in ``order`` (ties by ``tie_col``) within groups.

    ``group_cols`` must have few distinct, non-NULL values (features, arms);
    for many small groups a plain ``Window.partitionBy`` is already
    distributed.  Order columns must be non-NULL.  Without ``tie_col`` ties
    fall in either order.  ``n`` (rows, or a bound on them) saves the count.
    Builds eagerly: the placed rows are written before this returns.
    """
    for name, m in measures.items():
        df = df.withColumn(f"_m_{name}", m)
    if n is None:
        n = df.count()
    placed = _placed(df, order, tie_col, group_cols, n, rows_per_bucket)
    offsets = _offsets(placed, group_cols, {name: F.col(f"_m_{name}") for name in measures})
    if n > rows_per_bucket:
        placed = placed.repartition(WINDOW_SPREAD * choose_buckets(n, 1, rows_per_bucket), *group_cols, "_bucket")
    w = (Window.partitionBy(*group_cols, "_bucket").orderBy("_pos")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = placed.select("*", *[F.sum(f"_m_{name}").over(w).alias(f"_c_{name}") for name in measures])
    out = out.join(F.broadcast(offsets), [*group_cols, "_bucket"])  # <= B + G rows
    for name in measures:
        out = out.withColumn(name, F.col(f"_c_{name}") + F.col(f"_o_{name}"))
    return out.drop("_bucket", "_pos", "_first", *[f"_{p}_{name}" for name in measures for p in "mco"])


def global_rank(df: DataFrame, order: OrderSpec, tie_col: str | Column | None = None,
                group_cols: Sequence[str] = (), rank_col: str = "rank", n: int | None = None,
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add a 1-based ``rank_col`` in ``order`` (ties by ``tie_col``) within
    groups; the position in the sorted bucket gives it without any window."""
    placed = _placed(df, order, tie_col, group_cols, n, rows_per_bucket)
    offsets = _offsets(placed, group_cols, {"n": F.lit(1)})
    out = placed.join(F.broadcast(offsets), [*group_cols, "_bucket"])  # <= B + G rows
    rank = (F.col("_o_n") + F.col("_pos") - F.col("_first") + 1).cast("bigint")
    return out.withColumn(rank_col, rank).drop("_bucket", "_pos", "_first", "_o_n")


def ntile_from_rank(rank: Column, n: Column, k: int) -> Column:
    """SQL NTILE(k) from a 1-based rank: the first n mod k tiles get one extra row."""
    q = F.floor(n / k)
    rem = n - q * k
    big = rem * (q + 1)
    return (F.when(rank <= big, F.floor((rank - 1) / (q + 1)) + 1)
            .otherwise(rem + F.floor((rank - 1 - big) / F.greatest(q, F.lit(1))) + 1)).cast("int")


def decile_from_rank(rank: Column, n: Column, k: int = 10) -> Column:
    """Equal-size quantile bin of a 1-based rank (0 .. k-1), as pandas ``qcut``
    on ``rank(method='first')``: bins (e_i, e_i+1] with e_i = 1 + (n-1) i / k,
    in exact integer arithmetic."""
    a = rank - 1
    num = a * k + (n - 2)
    den = F.greatest(n - 1, F.lit(1))
    return F.when((a <= 0) | (n <= 1), F.lit(0)).otherwise(F.floor(num / den) - 1).cast("int")


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    group_cols: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact linear-interpolation quantiles, distributed at every size.

    Returns ``group_cols + (prob, value)``; ``value`` is NULL when there are no
    non-NULL values.  Same definition as numpy ``quantile`` (linear), Spark
    ``percentile`` and DuckDB ``quantile_cont``.

    Values are first counted per (group, value), which splits hot values and
    leaves unique sort keys.  With the running counts, the k-th smallest value
    is the smallest one whose count reaches k: one more aggregate for all
    probabilities, combined map-side.
    """
    value = F.col(value_col).cast("double")
    counts = (df.where(value.isNotNull() & ~F.isnan(value)).groupBy(*group_cols, value.alias("_v"))
              .agg(F.count(F.lit(1)).alias("_k")))
    run = global_cumsum(counts, [("_v", False)], {"_upto": F.col("_k")}, tie_col="_v", group_cols=group_cols,
                        rows_per_bucket=rows_per_bucket)
    sizes = run.groupBy(*group_cols).agg(F.max("_upto").alias("_n"))  # one row per group
    if group_cols:
        sized = run.join(F.broadcast(sizes), list(group_cols))
    else:
        sized = run.withColumn("_n", F.lit(sizes.first()["_n"]).cast("bigint"))

    def at(p: float, up: bool) -> Column:
        h = (F.col("_n") - 1) * F.lit(float(p))
        k = (F.ceil(h) if up else F.floor(h)).cast("bigint") + 1
        return F.min(F.when(F.col("_upto") >= k, F.col("_v")))

    picked = sized.groupBy(*group_cols).agg(
        F.max("_n").alias("_n"), *[x for i, p in enumerate(probs)
                                   for x in (at(p, False).alias(f"_lo{i}"), at(p, True).alias(f"_hi{i}"))])

    def interpolated(i: int, p: float) -> Column:
        h = (F.col("_n") - 1) * F.lit(float(p))
        frac = h - F.floor(h)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.struct(F.lit(float(p)).alias("prob"), F.when(frac == 0, lo).otherwise(lo + frac * (hi - lo)).alias("value"))

    rows = F.explode(F.array(*[interpolated(i, p) for i, p in enumerate(probs)]))
    return picked.select(*group_cols, rows.alias("_q")).select(*group_cols, "_q.prob", "_q.value")
