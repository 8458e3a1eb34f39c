"""Monitoring as Structured Streaming jobs over an event feed (E-1..E-4).

The analysis states cyclic duties but no stream: watch score drift, keep
SRM as a first gate that catches pipeline faults, and assign the
exploration slice at arrival.  Each duty is written once as a transformation
that works on a batch *or* a streaming DataFrame:

* E-1 :func:`windowed_bins` - per event-time window, counts per PSI bin of an
  incoming score against fixed reference edges; PSI per window
  (:func:`windowed_psi`) is written by the stream itself.
* E-2 :func:`windowed_arm_counts` - per window and arm: events, purchases and
  rate; :func:`window_srm` - SRM over the distinct users of each window.
* E-3 :func:`assign_at_arrival` - stateless keyed-hash epsilon-greedy action;
  :func:`sticky_actions` - the first action of a user in a cycle holds, kept as
  keyed state with a time to live.
* E-4 :func:`aa_test` - the control arm split in two keyed halves; their
  "effect" must be null.

Streams use a watermark on event time; rows later than the watermark are
dropped from window state.  Watermarks need TIMESTAMP (not NTZ) event time,
so the stream casts NTZ to TIMESTAMP under the session time zone (UTC).
State and progress live under ``<spark.checkpoint.dir>/streams/<name>``;
results go to Parquet files, nothing is kept on the driver, and a stopped
query goes on from its checkpoint without loss or doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlift.functions.hashing import keyed_uniform
from cartlift.functions.stats import chi2_df1_critical
from cartlift.operators.effects import ate_naive
from cartlift.session import ensure_checkpoint_dir
from cartlift.sources.raw import ARM, ID

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])

PURCHASE = "purchase"


def with_arm(events: DataFrame, salt: str = "arm", user: str = "user_id") -> DataFrame:
    """Arm of the event's user by the same keyed uniform as the experiment."""
    return events.withColumn(ARM, F.when(keyed_uniform(user, salt) < F.lit(0.5), 1).otherwise(0))


def _window(ts: str, size: str) -> Column:
    return F.window(F.col(ts), size)


def windowed_arm_counts(events: DataFrame, size: str = "1 day", ts: str = "ts") -> DataFrame:
    """E-2: per (window, arm) events, purchases and purchase rate."""
    ev = with_arm(events)
    return (ev.groupBy(_window(ts, size).alias("window"), ARM)
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.sum((F.col("event_type") == PURCHASE).cast("long")).alias("n_purchases"))
            .select(F.col("window.start").alias("window_start"), ARM, "n_events", "n_purchases",
                    (F.col("n_purchases") / F.col("n_events")).alias("purchase_rate")))


def window_users(events: DataFrame, size: str = "1 day", ts: str = "ts") -> DataFrame:
    """E-2: each user once per window, with the arm.  The arm belongs to the
    user, so a user's events are not independent draws of it."""
    return (with_arm(events).groupBy(_window(ts, size).alias("window"), "user_id", ARM)
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(F.col("window.start").alias("window_start"), "user_id", ARM))


def window_srm(users: DataFrame, ratio: float = 0.5, alpha: float = 0.001) -> DataFrame:
    """E-2: SRM chi-square of distinct users per window (input: :func:`window_users`)."""
    one = F.lit(1).cast("bigint")
    w = users.groupBy("window_start").agg(
        F.coalesce(F.sum(F.when(F.col(ARM) == 1, one)), F.lit(0)).cast("bigint").alias("n_treat"),
        F.coalesce(F.sum(F.when(F.col(ARM) == 0, one)), F.lit(0)).cast("bigint").alias("n_control"))
    n = F.col("n_treat") + F.col("n_control")
    et, ec = n * F.lit(ratio), n * F.lit(1.0 - ratio)
    chi2 = F.pow(F.col("n_treat") - et, 2) / et + F.pow(F.col("n_control") - ec, 2) / ec
    return w.select("window_start", "n_treat", "n_control", chi2.alias("chi2"),
                    (chi2 < F.lit(chi2_df1_critical(alpha))).alias("srm_ok"))


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """PSI bin: number of inner edges <= value (outer edges are -inf/+inf)."""
    arr = F.array(*[F.lit(float(e)) for e in edges])
    return F.size(F.filter(arr, lambda e: e <= value))


def reference_edges(reference: DataFrame, value: str, bins: int = 10) -> list[float]:
    """Inner PSI edges from a reference slice (bins - 1 numbers to the driver)."""
    from cartlift.operators.ranking import exact_quantiles
    q = exact_quantiles(reference, value, [i / bins for i in range(1, bins)])
    return [r["value"] for r in q.orderBy("prob").collect()]


def windowed_bins(events: DataFrame, edges: Sequence[float], value: str = "value",
                  size: str = "1 day", ts: str = "ts") -> DataFrame:
    """E-1: per (window, bin) counts of the incoming score."""
    ev = events.where(F.col(value).isNotNull())
    return (ev.groupBy(_window(ts, size).alias("window"), bin_of(F.col(value), edges).alias("bin"))
            .agg(F.count(F.lit(1)).alias("cnt"))
            .select(F.col("window.start").alias("window_start"), "bin", "cnt"))


def reference_shares(reference: DataFrame, edges: Sequence[float], value: str = "value") -> DataFrame:
    """Share of reference rows per PSI bin (at most ``len(edges) + 1`` rows)."""
    ref = reference.where(F.col(value).isNotNull())
    c = ref.groupBy(bin_of(F.col(value), edges).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    from pyspark.sql import Window
    return c.select("bin", (F.col("cnt") / F.sum("cnt").over(Window.partitionBy())).alias("e"))  # <= bins rows


def windowed_psi(bin_counts: DataFrame, ref_shares: DataFrame, bins: int = 10) -> DataFrame:
    """PSI per window from (window_start, bin, cnt) and reference shares (bin, e).

    Each window folds its at most ``bins`` counts into a map, then every bin
    is scored (empty ones at the 1e-6 share floor)."""
    per_window = bin_counts.groupBy("window_start").agg(
        F.sum("cnt").alias("tot"),
        F.map_from_entries(F.collect_list(F.struct("bin", "cnt"))).alias("counts"))  # <= bins entries
    cells = per_window.select("window_start", "tot", "counts",
                              F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    a = cells.join(F.broadcast(ref_shares), "bin", "left")  # bins rows
    share_a = F.greatest(F.coalesce(F.element_at("counts", F.col("bin")), F.lit(0)) / F.col("tot"), F.lit(1e-6))
    share_e = F.greatest(F.coalesce(F.col("e"), F.lit(0.0)), F.lit(1e-6))
    psi = a.groupBy("window_start").agg(F.sum((share_a - share_e) * F.log(share_a / share_e)).alias("psi"))
    return psi.withColumn("flag", F.when(F.col("psi") < 0.1, "OK").when(F.col("psi") < 0.25, "WATCH")
                          .otherwise("DRIFT"))


def assign_at_arrival(events: DataFrame, cutoff: float, epsilon: float = 0.05, cycle: str = "0",
                      value: str = "value", user: str = "user_id") -> DataFrame:
    """E-3: stateless epsilon-greedy action per arriving event's user.

    ``cutoff`` is the exploit threshold fixed for the cycle (e.g. the top-k%
    score quantile of the last batch run)."""
    explore = keyed_uniform(user, f"explore:{cycle}") < F.lit(epsilon)
    coin = keyed_uniform(user, f"coin:{cycle}") < F.lit(0.5)
    action = (F.when(explore & coin, "explore_treat").when(explore, "explore_control")
              .when(F.col(value) >= F.lit(float(cutoff)), "exploit_treat").otherwise("exploit_skip"))
    return events.withColumn("action", action)


STICKY_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("cycle", T.IntegerType()),
    T.StructField("action", T.StringType()), T.StructField("p_treat", T.DoubleType()),
    T.StructField("decided_by", T.LongType())])


def proposals(events: DataFrame, cutoffs: dict[int, float], start: str, cycle_days: int, epsilon: float,
              value: str = "value") -> DataFrame:
    """What each event alone would decide: cycle, action and p_treat; events of
    cycles without a cutoff are left out.  ``cutoffs`` has one entry per cycle."""
    from cartlift.operators.ledger import proposed_action, with_cycle
    ntz = events.withColumn("_ntz", F.col("ts").cast("timestamp_ntz"))
    numbered = with_cycle(ntz, start, cycle_days, "_ntz").where(F.col("cycle").isin(*cutoffs))
    known = F.create_map(*[x for c, v in cutoffs.items() for x in (F.lit(int(c)), F.lit(float(v)))])
    return proposed_action(numbered.withColumn("cutoff", known[F.col("cycle")]), epsilon, value).drop("_ntz")


def sticky_actions(events: DataFrame, cutoffs: dict[int, float], start: str, cycle_days: int = 7, epsilon: float = 0.05,
                   ttl_days: int = 21, keep_cycles: int = 3) -> DataFrame:
    """E-3 for a user: every event carries the action that the user's first event
    of the cycle decided (``decided_by``), whatever its own value says.

    State is one record per user with the actions of its newest ``keep_cycles``
    cycles; a user without events for ``ttl_days`` is dropped.  Of events that
    arrive in one micro-batch the earliest decides; an event that arrives later
    never changes an action that was already given.  A user's events of one
    micro-batch are read in Arrow batches, only their keys are held.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
    ttl_ms = ttl_days * 86_400_000
    state_schema = "cycles array<int>, actions array<string>, p_treats array<double>, decided array<bigint>"

    def decide(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = {c: (a, p, e) for c, a, p, e in zip(*state.get)} if state.exists else {}
        arrived = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for cycle, action, p_treat, event in arrived[["cycle", "action", "p_treat", "event_id"]].itertuples(index=False):
            held.setdefault(int(cycle), (action, float(p_treat), int(event)))
        given = [held[int(c)] for c in arrived["cycle"]]
        kept = sorted(held)[-keep_cycles:]
        state.update((kept, [held[c][0] for c in kept], [held[c][1] for c in kept], [held[c][2] for c in kept]))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"event_id": arrived["event_id"].to_numpy(), "user_id": key[0], "cycle": arrived["cycle"].to_numpy(),
                            "action": [g[0] for g in given], "p_treat": [g[1] for g in given],
                            "decided_by": [g[2] for g in given]})

    offered = proposals(events, cutoffs, start, cycle_days, epsilon).where(F.col("user_id").isNotNull()).select(
        "user_id", "event_id", "ts", "cycle", "action", "p_treat")
    return offered.groupBy("user_id").applyInPandasWithState(
        decide, STICKY_SCHEMA, state_schema, "append", GroupStateTimeout.ProcessingTimeTimeout)


def aa_test(train: DataFrame, salt: str = "aa") -> DataFrame:
    """E-4: split the never-treated control arm into two keyed halves and run
    the naive effect between them; a randomisation fault shows as an effect."""
    ctrl = train.where(F.col(ARM) == 0).withColumn(
        ARM, F.when(keyed_uniform(ID, salt) < F.lit(0.5), 1).otherwise(0))
    return ate_naive(ctrl)


# ---------------------------------------------------------------- stream runners

def event_stream(spark: SparkSession, source_dir: str, glob: str = "events*.parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in ``source_dir`` as a stream with event time ``ts``."""
    r = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(source_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def _start(writer, spark: SparkSession, name: str, available_now: bool):
    writer = writer.queryName(name).option("checkpointLocation", stream_checkpoint(spark, name))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _to_files(df: DataFrame, spark: SparkSession, name: str, path: str, available_now: bool):
    """Append to Parquet files; the sink's commit log makes a restart exact."""
    return _start(df.writeStream.outputMode("append").format("parquet").option("path", path), spark, name, available_now)


def batch_writer(path: str, transform) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: ``transform`` of a micro-batch, written under
    ``path/batch=<id>``.  A batch that is run again replaces its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
    return write


def start_arm_counts(spark: SparkSession, stream: DataFrame, name: str, path: str, size: str = "1 day",
                     watermark: str = "1 hour", available_now: bool = True):
    """E-2 as a running query: finalized (window, arm) events and rates to files."""
    return _to_files(windowed_arm_counts(stream.withWatermark("ts", watermark), size), spark, name, path, available_now)


def start_srm(spark: SparkSession, stream: DataFrame, name: str, path: str, size: str = "1 day",
              watermark: str = "1 hour", ratio: float = 0.5, alpha: float = 0.001, available_now: bool = True):
    """E-2 as a running query: SRM of distinct users for each finalized window.

    All rows of a window are emitted by the micro-batch in which the watermark
    passes it, so each window is judged once and whole."""
    users = window_users(stream.withWatermark("ts", watermark), size)
    write = batch_writer(path, lambda b: window_srm(b, ratio, alpha))
    return _start(users.writeStream.outputMode("append").foreachBatch(write), spark, name, available_now)


def start_running_srm(spark: SparkSession, stream: DataFrame, name: str, path: str, size: str = "1 day",
                      available_now: bool = True):
    """E-2 under continual looks as a running query: new users per window and
    micro-batch under ``path/batch=<id>``.  State is one key per user of the
    experiment, kept for good: a user counts once however late it comes back.
    :func:`running_srm_so_far` adds the counts up and tests them."""
    from cartlift.operators import sequential
    users = with_arm(stream.where(F.col("user_id").isNotNull())).dropDuplicates(["user_id"]).select(
        F.window("ts", size)["start"].alias("window_start"), "user_id", ARM)
    return _start(users.writeStream.outputMode("append").foreachBatch(batch_writer(path, sequential.arm_counts)),
                  spark, name, available_now)


def running_srm_so_far(spark: SparkSession, path: str, ratio: float = 0.5, alpha: float = 0.001,
                       tuned_for: float = 1000.0) -> DataFrame:
    """The running test over all windows that the stream has seen."""
    from cartlift.operators import sequential
    return sequential.running_srm(spark.read.parquet(path).drop("batch"), ratio, alpha, tuned_for)


def start_psi(spark: SparkSession, stream: DataFrame, edges: Sequence[float], ref_shares: DataFrame, name: str,
              path: str, size: str = "1 day", watermark: str = "1 hour", available_now: bool = True):
    """E-1 as a running query: PSI and its flag for each finalized window.
    ``ref_shares`` has one row per bin; it is read once, here."""
    rows = [(r["bin"], r["e"]) for r in ref_shares.collect()]
    counts = windowed_bins(stream.withWatermark("ts", watermark), edges, size=size)
    bins = len(edges) + 1

    def score(batch: DataFrame) -> DataFrame:
        return windowed_psi(batch, batch.sparkSession.createDataFrame(rows, "bin int, e double"), bins)

    writer = counts.writeStream.outputMode("append").foreachBatch(batch_writer(path, score))
    return _start(writer, spark, name, available_now)


def start_drift(spark: SparkSession, stream: DataFrame, cols: Sequence[str], profile_path: str, name: str, path: str,
                size: str = "1 day", available_now: bool = True):
    """E-1 over key columns as a running query: (feature, version, period, bin)
    counts of each micro-batch, written under ``path/batch=<id>``.

    Every micro-batch reads the published profiles anew, so new edges count
    from their ``valid_from`` on under the same checkpoint.  Counts are added up
    when they are read (:func:`drift_so_far`), so late events still count and the
    stream itself keeps no state; a repeated batch replaces its folder."""
    from cartlift.operators import drift

    def count(batch: DataFrame) -> DataFrame:
        ntz = batch.withColumn("_ntz", F.col("ts").cast("timestamp_ntz"))
        period = F.window("ts", size)["start"].cast("timestamp_ntz")
        return drift.bin_counts(ntz, cols, period, drift.read_profiles(batch.sparkSession, profile_path), "_ntz")

    writer = stream.writeStream.outputMode("append").foreachBatch(batch_writer(path, count))
    return _start(writer, spark, name, available_now)


def drift_so_far(spark: SparkSession, path: str, profile_path: str) -> DataFrame:
    """PSI of every period that the drift stream has seen, against the profile valid then."""
    from cartlift.operators import drift
    return drift.psi_against_profile(spark.read.parquet(path).drop("batch"), drift.read_profiles(spark, profile_path))


def start_assignment(spark: SparkSession, stream: DataFrame, cutoff: float, name: str, path: str,
                     epsilon: float = 0.05, cycle: str = "0", available_now: bool = True):
    """E-3 as a running query: stateless append of (event_id, user_id, action) to files."""
    out = assign_at_arrival(stream, cutoff, epsilon, cycle).select("event_id", "user_id", "action")
    return _to_files(out, spark, name, path, available_now)


def start_sticky_assignment(spark: SparkSession, stream: DataFrame, cutoffs: dict[int, float], start: str, name: str,
                            path: str, cycle_days: int = 7, epsilon: float = 0.05, ttl_days: int = 21,
                            available_now: bool = True):
    """E-3 as a running query: sticky actions to files; after a restart users keep their actions.

    A query with processing-time timeouts asks for batches without data for
    ever, so one that shall end with its input (``available_now``) starts
    without them; its timeouts are then seen with the next data."""
    option = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(option)
    spark.conf.set(option, "false" if available_now else before)  # read when the query starts
    try:
        return _to_files(sticky_actions(stream, cutoffs, start, cycle_days, epsilon, ttl_days), spark, name, path, available_now)
    finally:
        spark.conf.set(option, before)
