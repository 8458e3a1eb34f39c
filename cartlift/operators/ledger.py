"""Decision ledger: logged actions, the outcomes that follow, off-policy estimates (O-69d, O-69f).

A *cycle* is a stretch of ``cycle_days``.  A user's first event in a cycle is
the decision of that cycle: the epsilon-greedy action of its score, against a
cutoff that was known before the cycle began (a quantile of the cycle before).
The action holds for the whole cycle.  The ledger keeps it with the probability
that it would have been a treatment, and later learns whether the user
responded within ``horizon_days`` after it: the next cycle's outcomes, not
those the cutoff was found on.

The interval join "an outcome in (t, t + H]" needs no range comparison of rows:
time is cut into buckets of width H, and with t in bucket b an outcome of b that
is later than t lies inside, as does one of b + 1 that is at most t + H.  So the
latest outcome of bucket b and the earliest of b + 1 decide, one pre-aggregated
row per (user, bucket); each action meets two of them, however many outcomes a
user has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlift.functions.dates import elapsed_micros
from cartlift.functions.hashing import salted_uniform
from cartlift.operators.curves import decile_table
from cartlift.operators.ranking import exact_quantiles
from cartlift.sources.raw import ARM, ID, OUTCOME

MICROS_PER_DAY = 86_400_000_000
EPOCH = "1970-01-01"


def _micros(ts: Column | str, since: str) -> Column:
    return elapsed_micros(ts, F.lit(since).cast("timestamp_ntz"))


def with_cycle(events: DataFrame, start: str, cycle_days: int, ts: str = "ts") -> DataFrame:
    """Number of the event's cycle; cycles before ``start`` are negative."""
    return events.withColumn("cycle", F.floor(_micros(ts, start) / F.lit(cycle_days * MICROS_PER_DAY)).cast("int"))


def cycle_cutoffs(events: DataFrame, k: float = 0.30, score: str = "value") -> DataFrame:
    """(cycle, cutoff): the top-k% score of the cycle before (one row per cycle)."""
    q = exact_quantiles(events.where(F.col("cycle").isNotNull()), score, [1.0 - k], group_cols=["cycle"])
    return q.select((F.col("cycle") + 1).alias("cycle"), F.col("value").alias("cutoff"))


def proposed_action(events: DataFrame, epsilon: float, score: str = "value", user: str = "user_id") -> DataFrame:
    """What epsilon-greedy would do at each event (O-69d), given ``cycle`` and
    ``cutoff``: ``action``, ``treatment_flg`` and ``p_treat``, the probability of
    treatment given the score.  The cycle salts the user's draws."""
    explore = salted_uniform(user, F.concat(F.lit("explore:"), F.col("cycle").cast("string"))) < F.lit(epsilon)
    coin = salted_uniform(user, F.concat(F.lit("coin:"), F.col("cycle").cast("string"))) < F.lit(0.5)
    above = F.coalesce(F.col(score) >= F.col("cutoff"), F.lit(False))
    action = (F.when(explore & coin, "explore_treat").when(explore, "explore_control")
              .when(above, "exploit_treat").otherwise("exploit_skip"))
    return events.withColumns({
        "action": action, ARM: F.when(action.endswith("_treat"), 1).otherwise(0),
        "p_treat": F.lit(epsilon / 2) + F.when(above, F.lit(1.0 - epsilon)).otherwise(F.lit(0.0))})


def first_decisions(events: DataFrame, cutoffs: DataFrame, epsilon: float = 0.05, score: str = "value",
                    user: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """One row per user and cycle: the action of the user's first event (O-69d, E-3).
    Cycles without a cutoff (nothing before them) have no decisions."""
    first = events.groupBy(user, "cycle").agg(F.min(F.struct(ts, event, score)).alias("first"))
    own = first.select(user, "cycle", f"first.{ts}", f"first.{event}", f"first.{score}")
    known = own.join(F.broadcast(cutoffs), "cycle")  # one row per cycle
    return proposed_action(known, epsilon, score, user)


def follow_up(actions: DataFrame, outcomes: DataFrame, horizon_days: int, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """``actions`` with ``target`` = 1 if ``outcomes`` has a row of the user in (ts, ts + horizon]."""
    width = horizon_days * MICROS_PER_DAY
    at = _micros(ts, EPOCH)
    per_bucket = (outcomes.select(F.col(user).alias("_user"), at.alias("_at"))
                  .groupBy("_user", F.floor(F.col("_at") / F.lit(width)).alias("_bucket"))
                  .agg(F.min("_at").alias("_first"), F.max("_at").alias("_last")))
    asked = (actions.withColumn("_t", at).withColumn("_own", F.floor(F.col("_t") / F.lit(width)))
             .withColumn("_bucket", F.explode(F.array(F.col("_own"), F.col("_own") + 1))))
    met = (asked.join(per_bucket, (F.col(user) == F.col("_user")) & (asked["_bucket"] == per_bucket["_bucket"]), "left")
           .withColumn("_hit", F.when(asked["_bucket"] == F.col("_own"), F.col("_last") > F.col("_t"))
                       .otherwise(F.col("_first") <= F.col("_t") + F.lit(width))))
    keep = actions.columns
    return (met.groupBy(*keep).agg(F.max(F.coalesce("_hit", F.lit(False)).cast("int")).alias(OUTCOME)))


def ledger(events: DataFrame, start: str, cycles: int, cycle_days: int = 7, horizon_days: int = 7, epsilon: float = 0.05,
           k: float = 0.30, outcome: Column | None = None, score: str = "value", user: str = "user_id") -> DataFrame:
    """Decisions of ``cycles`` cycles from ``start`` on with their outcomes:
    (user, cycle, ts, event_id, score, cutoff, action, treatment_flg, p_treat, target)."""
    numbered = with_cycle(events, start, cycle_days)
    cutoffs = cycle_cutoffs(numbered.where(F.col("cycle").between(-1, cycles - 2)), k, score)
    actions = first_decisions(numbered.where(F.col("cycle").between(0, cycles - 1)), cutoffs, epsilon, score, user)
    happened = events.where(F.col("event_type") == "purchase" if outcome is None else outcome)
    return follow_up(actions, happened, horizon_days, user)


def ledger_rates(book: DataFrame) -> DataFrame:
    """Decisions and response rate per cycle and action."""
    return book.groupBy("cycle", "action").agg(F.count(F.lit(1)).alias("n"), F.sum(OUTCOME).alias("n_responded"),
                                               F.avg(OUTCOME).alias("rate"))


def explore_deciles(book: DataFrame, score: str = "value", event: str = "event_id", rank_kw: dict | None = None) -> DataFrame:
    """Decile table (O-62) of the randomised slice of all cycles; the unit is the decision."""
    explored = book.where(F.col("action").startswith("explore"))
    return decile_table(explored.select(F.col(event).alias(ID), ARM, OUTCOME, score), score, rank_kw)


def weighted_effect(book: DataFrame, z: float = 1.96) -> DataFrame:
    """Effect of treating everybody, from all decisions, by inverse propensities,
    per cycle and pooled (cycle NULL).

    Each decision counts 1 / P(its arm); ``ate`` divides by the sum of weights
    (Hajek), ``ate_ht`` by the number of decisions.  The error is that of the
    linearised Hajek estimate.  ``ess_*``: effective decisions per arm, (sum of
    weights)^2 / sum of squared weights.
    """
    t, y, p = F.col(ARM).cast("double"), F.col(OUTCOME).cast("double"), F.col("p_treat")
    w1, w0 = t / p, (1 - t) / (1 - p)
    sums = {"n": F.count(F.lit(1)).cast("double"), "w1": F.sum(w1), "w0": F.sum(w0), "y1": F.sum(w1 * y), "y0": F.sum(w0 * y),
            "q1": F.sum(w1 * w1), "q0": F.sum(w0 * w0), "qy1": F.sum(w1 * w1 * y), "qy0": F.sum(w0 * w0 * y),
            "qyy1": F.sum(w1 * w1 * y * y), "qyy0": F.sum(w0 * w0 * y * y)}
    s = book.rollup("cycle").agg(*[v.alias(k) for k, v in sums.items()])
    m1, m0 = F.try_divide("y1", "w1"), F.try_divide("y0", "w0")

    def spread(m: Column, arm: str) -> Column:  # sum of (w (y - m))^2
        return F.col(f"qyy{arm}") - 2 * m * F.col(f"qy{arm}") + m * m * F.col(f"q{arm}")

    var = (F.try_divide(spread(m1, "1"), F.col("w1") * F.col("w1")) + F.try_divide(spread(m0, "0"), F.col("w0") * F.col("w0")))
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    return (s.withColumns({"ate": m1 - m0, "se": se})
            .select("cycle", F.col("n").cast("bigint").alias("n"), m1.alias("rate_treat"), m0.alias("rate_control"), "ate", "se",
                    (F.col("ate") - z * F.col("se")).alias("ci_lo"), (F.col("ate") + z * F.col("se")).alias("ci_hi"),
                    ((F.col("y1") - F.col("y0")) / F.col("n")).alias("ate_ht"),
                    F.try_divide(F.col("w1") * F.col("w1"), F.col("q1")).alias("ess_treat"),
                    F.try_divide(F.col("w0") * F.col("w0"), F.col("q0")).alias("ess_control")))
