"""Decision ledger: sticky first actions, interval join, inverse-propensity effect."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cartlift.operators import ledger as L

START = "2024-01-08"
DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 8)


def frame(spark, rows, schema="user_id long, ts timestamp_ntz, event_id long, event_type string, value double"):
    return spark.createDataFrame(rows, schema)


def test_follow_up_borders(spark):
    """Outcomes at t and after t + H don't count, those at t + H do; in either bucket."""
    us = dt.timedelta(microseconds=1)
    cases = [(T0 + 3 * DAY, [0 * us], 0), (T0 + 3 * DAY, [us], 1), (T0 + 3 * DAY, [7 * DAY], 1), (T0 + 3 * DAY, [7 * DAY + us], 0),
             (T0 + 3 * DAY, [-DAY, 9 * DAY], 0), (T0 + 3 * DAY, [-DAY, 0 * us, 5 * DAY, 30 * DAY], 1), (T0, [7 * DAY], 1),
             (T0 - us, [us], 1), (T0, [], 0), (dt.datetime(1969, 12, 30), [6 * DAY], 1), (dt.datetime(1969, 12, 30), [8 * DAY], 0)]
    actions = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)] + [(None, T0), (77, None)], "user_id long, ts timestamp_ntz")
    outcomes = spark.createDataFrame([(i, t + d) for i, (t, ds, _) in enumerate(cases) for d in ds] + [(None, T0 + DAY)],
                                     "user_id long, ts timestamp_ntz")
    got = {r.user_id: r.target for r in L.follow_up(actions, outcomes, 7).collect()}
    assert got == {**{i: want for i, (*_, want) in enumerate(cases)}, None: 0, 77: 0}


def test_interval_join_matches_all_pairs(spark):
    rng = np.random.default_rng(1)
    a = pd.DataFrame({"user_id": rng.integers(0, 8, 60), "ts": [T0 + DAY * float(x) for x in rng.uniform(0, 30, 60)], "k": range(60)})
    o = pd.DataFrame({"user_id": np.where(rng.random(80) < 0.5, 3, rng.integers(0, 8, 80)),
                      "ts": [T0 + DAY * float(x) for x in rng.uniform(0, 40, 80)]})
    want = {r.k: int(((o.user_id == r.user_id) & (o.ts > r.ts) & (o.ts <= r.ts + 3 * DAY)).any()) for r in a.itertuples()}
    spark_a = spark.createDataFrame(a).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    spark_o = spark.createDataFrame(o).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert {r.k: r.target for r in L.follow_up(spark_a, spark_o, 3).collect()} == want


def test_first_event_decides_and_cycles_need_a_cutoff(spark):
    rows = [(1, T0 + DAY, 11, "view", 90.0), (1, T0 + 2 * DAY, 12, "view", 1.0), (1, T0 + DAY, 10, "view", 5.0),
            (2, T0 + 8 * DAY, 20, "view", None), (3, T0 - DAY, 30, "view", 50.0), (4, T0 - 20 * DAY, 40, "view", 50.0)]
    ev = L.with_cycle(frame(spark, rows), START, 7)
    assert [r.cycle for r in ev.orderBy("event_id").collect()] == [0, 0, 0, 1, -1, -3]
    cut = spark.createDataFrame([(0, 10.0), (1, 10.0)], "cycle int, cutoff double")
    got = {(r.user_id, r.cycle): (r.event_id, r.action, r.p_treat) for r in L.first_decisions(ev, cut, epsilon=0.0).collect()}
    assert got == {(1, 0): (10, "exploit_skip", 0.0), (2, 1): (20, "exploit_skip", 0.0)}  # a missing score is never above


def test_cutoff_is_that_of_the_cycle_before(spark):
    rows = [(i, T0 - DAY, i, "view", float(i)) for i in range(1, 11)] + [(i, T0 + DAY, 100 + i, "view", 1000.0) for i in range(5)]
    got = {r.cycle: r.cutoff for r in L.cycle_cutoffs(L.with_cycle(frame(spark, rows), START, 7), 0.3).collect()}
    assert abs(got[0] - np.quantile(range(1, 11), 0.7)) < 1e-12 and got[1] == 1000.0


def test_weighted_effect_recovers_what_the_policy_hides(spark):
    """High scores respond more anyway and are treated by the policy: the plain
    difference is far off, the weighted one is not; pooling narrows it."""
    rng = np.random.default_rng(4)
    n, eps, rows = 12_000, 0.2, []
    for i in range(n):
        score = rng.random()
        p = eps / 2 + (1 - eps) * (score >= 0.7)
        t = int(rng.random() < p)
        rows.append((i, int(i % 2), t, float(p), int(rng.random() < 0.2 + 0.4 * score + 0.1 * t)))
    book = spark.createDataFrame(rows, "event_id long, cycle int, treatment_flg int, p_treat double, target int")
    got = {r.cycle: r for r in L.weighted_effect(book).collect()}
    d = pd.DataFrame(rows, columns=["e", "c", "t", "p", "y"])
    plain = d[d.t == 1].y.mean() - d[d.t == 0].y.mean()
    assert plain > 0.2 and set(got) == {None, 0, 1}
    assert got[None].ci_lo < 0.1 < got[None].ci_hi and abs(got[None].ate - 0.1) < 0.04
    assert got[None].se < min(got[0].se, got[1].se) and got[None].ess_treat < (d.t == 1).sum()


def test_edges(spark):
    empty = frame(spark, [])
    assert L.ledger(empty, START, 2).count() == 0
    assert L.ledger_rates(L.ledger(empty, START, 2)).count() == 0
    only = spark.createDataFrame([(0, 1, 0.5, 1)], "cycle int, treatment_flg int, p_treat double, target int")
    r = {x.cycle: x for x in L.weighted_effect(only).collect()}
    assert r[0].rate_treat == 1.0 and r[0].rate_control is None and r[0].ate is None
