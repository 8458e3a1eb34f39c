"""Sample-ratio check under continual looks."""

import math

import numpy as np
from pyspark.sql import functions as F
from test_streaming import DAYS, _batch, _events, _run

from cartlift.functions.stats import chi2_df1_critical
from cartlift.operators import sequential as S
from cartlift.streaming import jobs

ALPHA, LOOKS, RUNS = 0.05, 30, 400


def simulated(spark, p, seed):
    rng = np.random.default_rng(seed)
    treat = rng.binomial(60, p, (RUNS, LOOKS))
    rows = [(r, d, int(t), int(60 - t)) for r, own in enumerate(treat) for d, t in enumerate(own)]
    return spark.createDataFrame(rows, "run int, window_start int, n_treat long, n_control long"), treat


def test_a_null_stream_alarms_in_at_most_alpha_of_runs(spark):
    """Over all looks together; the chi-square of each window alone alarms in most runs."""
    counts, treat = simulated(spark, 0.5, 1)
    out = S.running_srm(counts, alpha=ALPHA, group_cols=["run"])
    ever = out.groupBy("run").agg(F.min(F.col("srm_ok").cast("int")).alias("ok")).agg(F.avg(1 - F.col("ok"))).first()[0]
    chi2 = (treat - 30) ** 2 / 30 + (30 - treat) ** 2 / 30
    alone = (chi2 >= chi2_df1_critical(ALPHA)).any(1).mean()
    assert ever <= ALPHA and alone > 0.5
    p = out.groupBy("run").agg(F.min("p_value").alias("p")).toPandas().p
    assert all((p <= a).mean() <= a + 2 * math.sqrt(a / RUNS) for a in (0.01, 0.05, 0.2))


def test_a_broken_ratio_is_found_and_stays_found(spark):
    counts, _ = simulated(spark, 0.56, 2)
    out = S.running_srm(counts, alpha=ALPHA, group_cols=["run"]).toPandas().sort_values(["run", "window_start"])
    assert (~out.groupby("run").srm_ok.last()).mean() > 0.9
    assert out.groupby("run").srm_ok.apply(lambda s: (np.diff(s.astype(int)) <= 0).all()).all()


def test_closed_form_and_uneven_plan(spark):
    counts = spark.createDataFrame([(1, 30, 10), (1, 5, 5), (2, 0, 0)], "window_start int, n_treat long, n_control long")
    got = S.running_srm(counts, ratio=0.7, tuned_for=100).orderBy("window_start").collect()
    n, s, v = 50, 35 - 35, 0.04
    assert abs(got[0].log_e - (-0.5 * math.log(1 + n * v / 4) + v * s * s / 2 / (1 + n * v / 4))) < 1e-12
    assert (got[1].n_treat, got[1].n_control, got[1].p_value) == (35, 15, 1.0)
    assert S.running_srm(counts.limit(0)).count() == 0


def test_stream_counts_each_user_once_over_restarts(spark, tmp_path):
    ev, src, out = _events(), tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    _run(spark, lambda s: jobs.start_running_srm(spark, s, f"rsrm_{tmp_path.name}", out), src, ev)
    seen = _batch(spark, ev[ev.ts < DAYS[-1][1]])
    last = jobs.running_srm_so_far(spark, out).orderBy(F.desc("window_start")).first()
    want = S.running_srm(S.first_windows(jobs.window_users(seen))).orderBy(F.desc("window_start")).first()
    assert (last.n_treat, last.n_control) == (want.n_treat, want.n_control)
    assert last.n_treat + last.n_control == ev[ev.ts < DAYS[-1][1]].user_id.nunique()
