"""Drift cube, versioned profiles, quantile sketches."""

import os
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cartlift.operators import drift as D
from cartlift.operators import sketches as S
from cartlift.operators.policy import targeting_policy
from cartlift.streaming import jobs


def frame(spark, values, period="a", ts="2024-01-01 00:00:00"):
    rows = [(period, ts, None if v is None else float(v), None if v is None else float(-v)) for v in values]
    return spark.createDataFrame(rows, "period string, at string, x double, y double").withColumn("at", F.col("at").cast("timestamp_ntz"))


def plain_psi(ref, act, bins=10):
    e = np.quantile(ref, [i / bins for i in range(1, bins)])

    def share(v):
        n = np.bincount(np.searchsorted(e, v, side="right"), minlength=bins) / len(v)
        return np.maximum(n, 1e-6)
    a, b = share(act), share(ref)
    return float(((a - b) * np.log(a / b)).sum())


def test_cube_matches_numpy_and_counts_add_up(spark):
    rng = np.random.default_rng(0)
    base, same, moved = rng.normal(size=400), rng.normal(size=300), rng.normal(1, 1, size=300)
    ref = frame(spark, base, "ref")
    both = frame(spark, [*same, None, float("nan")], "same").unionByName(frame(spark, moved, "moved"))
    profile = D.reference_profile(ref, ["x", "y"])
    counts = D.bin_counts(both.unionByName(ref), ["x", "y"], F.col("period"), profile).cache()
    got = {(r.feature, r.period): r for r in D.psi_against_profile(counts, profile).collect()}
    for p, v in (("same", same), ("moved", moved)):
        assert abs(got["x", p].psi - plain_psi(base, v)) < 1e-9 and got["x", p].n == 300
    assert got["x", "ref"].psi == 0 and got["x", "moved"].flag == "DRIFT" and got["x", "same"].flag == "OK"
    # two passes over halves add up to one
    halves = [D.bin_counts(frame(spark, h, "moved"), ["x"], F.col("period"), profile) for h in (moved[:100], moved[100:])]
    merged = D.psi_against_profile(halves[0].unionByName(halves[1]), profile).first()
    assert abs(merged.psi - got["x", "moved"].psi) < 1e-12 and merged.n == 300
    pairs = spark.createDataFrame([("moved", "same"), ("same", "nothing")], "period string, reference string")
    between = D.psi_between(counts, profile, pairs).collect()
    assert {(r.feature, r.period, r.reference) for r in between} == {("x", "moved", "same"), ("y", "moved", "same")}


def test_versions_take_over_at_their_time(spark, tmp_path):
    path = str(tmp_path / "profiles")
    D.publish_profile(D.reference_profile(frame(spark, range(100)), ["x"], 1), path)
    D.publish_profile(D.reference_profile(frame(spark, range(1000, 1100)), ["x"], 2, "2024-02-01"), path)
    profiles = D.read_profiles(spark, path)
    data = frame(spark, range(100), "jan", "2024-01-31 23:59:59").unionByName(frame(spark, range(1000, 1100), "feb", "2024-02-01 00:00:00"))
    got = {r.period: r for r in D.psi_against_profile(D.bin_counts(data, ["x"], F.col("period"), profiles, "at"), profiles).collect()}
    assert {p: r.version for p, r in got.items()} == {"jan": 1, "feb": 2} and all(r.psi < 1e-9 for r in got.values())
    D.publish_profile(D.reference_profile(frame(spark, range(500)), ["x"], 2, "2024-02-01"), path)  # published again
    assert D.read_profiles(spark, path).count() == 2


def test_empty_and_constant(spark):
    empty = frame(spark, [])
    assert D.reference_profile(empty, ["x"]).count() == 0
    profile = D.reference_profile(frame(spark, [5.0] * 20), ["x"])
    r = D.psi_against_profile(D.bin_counts(frame(spark, [5.0] * 7), ["x"], F.col("period"), profile), profile).first()
    assert r.psi == 0 and r.n == 7
    assert D.bin_counts(empty, ["x"], F.col("period"), profile).count() == 0


def _file(src, k, day, values):
    pd.DataFrame({"event_id": np.arange(len(values)) + 1000 * k, "ts": pd.to_datetime([day] * len(values)).astype("datetime64[us]"),
                  "user_id": 1, "event_type": "view", "value": np.asarray(values, float), "props": ""}
                 ).to_parquet(src / f"events-{k}.parquet", index=False)
    os.utime(src / f"events-{k}.parquet", (time.time() - 1000 + 20 * k,) * 2)


def test_stream_takes_new_edges_under_the_same_checkpoint(spark, tmp_path):
    src, out, profiles = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "profiles")
    src.mkdir()

    def run():
        q = jobs.start_drift(spark, jobs.event_stream(spark, str(src), max_files_per_trigger=1), ["value"], profiles,
                             f"drift_{tmp_path.name}", out)
        q.awaitTermination()
        assert q.exception() is None

    def profile(lo, version, since):
        d = spark.createDataFrame([(float(v),) for v in range(lo, lo + 100)], "value double")
        D.publish_profile(D.reference_profile(d, ["value"], version, since), profiles)

    profile(0, 1, "0001-01-01")
    _file(src, 0, "2024-01-01", range(100))
    run()
    profile(1000, 2, "2024-01-02")
    _file(src, 1, "2024-01-02", range(1000, 1100))
    _file(src, 2, "2024-01-01", range(50))  # late rows of the first day are added to it
    run()
    got = {str(r.period)[:10]: (r.version, r.n, r.psi < 1e-9) for r in jobs.drift_so_far(spark, out, profiles).collect()}
    assert got == {"2024-01-01": (1, 150, False), "2024-01-02": (2, 100, True)}


def test_sketches_merge_by_day_and_replace_days(spark, tmp_path):
    rng = np.random.default_rng(2)
    path, all_values = str(tmp_path / "sketches"), {}
    for day in ("2024-01-01", "2024-01-02", "2024-01-01"):  # the first day is stored again, corrected
        all_values[day] = rng.lognormal(size=20_000)
        d = spark.createDataFrame(pd.DataFrame({"v": all_values[day]}))
        S.store_sketches(S.daily_sketches(d, "v", F.lit(day)), path)
    values = np.concatenate(list(all_values.values()))
    merged = S.merged_quantiles(S.read_sketches(spark, path), [0.1, 0.7, 0.99])
    for r in merged.collect():
        assert r.n == 40_000 and abs((values <= r.value).mean() - r.prob) < 2 * S.rank_error()
    assert S.approximate_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0


def test_approximate_policy_cutoff(spark):
    d = spark.range(20_000).select(F.col("id").alias("client_id"), F.rand(3).alias("s"))
    for approximate in (False, True):
        share = targeting_policy(d, "s", 0.3, approximate=approximate).where("targeted").count() / 20_000
        assert abs(share - 0.3) < (2 * S.rank_error() if approximate else 1e-4)
