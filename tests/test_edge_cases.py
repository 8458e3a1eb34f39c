"""Hand-built edge frames (FIXTURES.md section 5) and property checks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartlift.config import AnalysisConfig
from cartlift.operators import curves, effects, monitoring, policy, product, validity
from cartlift.operators.features import customer_features, feature_names
from cartlift.operators.readout import adjusted_effect
from cartlift.sources.raw import prepare_clients, prepare_purchases

P_COLS = ("client_id long, transaction_id long, transaction_datetime string, product_id long, store_id long, "
          "purchase_sum double, regular_points_received double, regular_points_spent double, "
          "express_points_received double, express_points_spent double, trn_sum_from_iss double, "
          "trn_sum_from_red double")
C_COLS = "client_id long, age double, gender string, first_issue_date string, first_redeem_date string"
T_COLS = "client_id long, target int, treatment_flg int"


def line(cid, tx, ts, prod, amount=100.0, store=1):
    return (cid, tx, ts, prod, store, amount, 1.0, 0.0, 0.0, 0.0, amount / 2, None)


@pytest.fixture(scope="module")
def edge_tables(spark):
    purchases = [
        # single_tx: 3 lines, same purchase_sum
        line(1, 10, "2020-01-10 10:00:00", 1), line(1, 10, "2020-01-10 10:00:00", 2),
        line(1, 10, "2020-01-10 10:00:00", 3),
        # month_edge: 31 Jan 23:59 and 1 Feb 00:00
        line(2, 20, "2020-01-31 23:59:00", 1), line(2, 21, "2020-02-01 00:00:00", 1),
        # bad timestamp and a NaN amount
        line(3, 30, "not a date", 1), line(3, 31, "2020-03-01 12:00:00", 1, amount=float("nan")),
        # reference time = latest purchase
        line(4, 40, "2020-06-01 00:00:00", 5),
    ]
    clients = [
        (1, 30.0, "F", "2019-01-01 00:00:00", "2020-06-01 01:00:00"),  # future_redeem (+1 hour)
        (2, 40.0, "M", "2019-01-01 00:00:00", None),
        (3, None, None, "2019-01-01 00:00:00", "2019-06-01 00:00:00"),
        (4, 50.0, "F", None, None),
    ]
    train = [(1, 1, 1), (2, 0, 0), (3, 1, 0), (4, 0, 1), (5, 1, 1)]  # 5: no history, no client row
    p = prepare_purchases(spark.createDataFrame(purchases, P_COLS))
    c = prepare_clients(spark.createDataFrame(clients, C_COLS))
    t = spark.createDataFrame(train, T_COLS)
    return t, c, p


def test_feature_edges(spark, edge_tables):
    t, c, p = edge_tables
    f = customer_features(t, c, p, gender_cats=["F", "M"])
    rows = {r.client_id: r for r in f.collect()}
    assert len(rows) == 5
    one = rows[1]
    assert one.n_tx == 1 and one.spend_total == 100.0 and one.spend_std is None and one.tenure_days == 0
    assert one.redeem_recency_days == -1          # redeem one hour after the reference time
    assert one.basket_mean == 3.0
    assert rows[3].spend_total is None or math.isnan(rows[3].spend_total) is False
    assert rows[3].n_tx == 2                       # bad timestamp still a transaction
    none = rows[5]
    assert none.n_tx is None and none.has_redeemed is None and none.gender_nan == 1
    assert rows[2].has_redeemed == 0.0 and rows[1].has_redeemed == 1.0
    # gender_complete: only F and M -> gender_M and an all-zero-but-present gender_nan
    assert "gender_M" in f.columns and "gender_nan" in f.columns and "gender_F" not in f.columns
    # no-history customer counts in customers, not in averages; recent flag 0
    m = product.core_metrics(f).first()
    assert m.customers == 5
    d = validity.experiment_design(f, window_days=7).first()
    assert d.base_rate == pytest.approx(1 / 5)   # only customer 4 bought in the last 7 days


def test_nan_amount_is_null(spark, edge_tables):
    _, _, p = edge_tables
    vals = [r.purchase_sum for r in p.where("client_id = 3").collect()]
    assert None in vals and not any(isinstance(v, float) and math.isnan(v) for v in vals)


def test_cohort_edges(spark, edge_tables):
    _, _, p = edge_tables
    ret = product.cohort_retention(p).collect()
    cells = {(str(r.cohort), r.month_offset): r for r in ret}
    assert ("2020-01-01", 1) in cells              # 31 Jan 23:59 and 1 Feb 00:00 -> offset 1
    assert all(r.retention == 1.0 for r in ret if r.month_offset == 0)
    assert all(r.cohort is not None for r in ret)  # bad timestamps kept out of cohorts


def test_segments_and_unknown(spark, edge_tables):
    t, c, p = edge_tables
    f = customer_features(t, c, p, gender_cats=["F", "M"])
    seg = {r.client_id: r.rfm_segment for r in product.attach_segments(f).collect()}
    assert seg[5] == "unknown" and set(seg.values()) <= {"champions", "at_risk", "mid", "unknown"}


def test_rfm_ties_by_id(spark):
    rows = [(i, 5, 3, 100.0) for i in range(12)]
    f = spark.createDataFrame(rows, "client_id long, recency_days long, n_tx long, spend_total double")
    r = product.rfm_scores(f, {"rows_per_bucket": 4}).toPandas().sort_values("client_id")
    assert r.R.tolist() == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 5, 5]
    assert r.R.value_counts().sort_index().tolist() == [3, 3, 2, 2, 2]


def _arm_frame(spark, ys_t, ys_c, seg="mid"):
    rows = [(i, y, 1, seg) for i, y in enumerate(ys_t)] + [(1000 + i, y, 0, seg) for i, y in enumerate(ys_c)]
    return spark.createDataFrame(rows, "client_id long, target int, treatment_flg int, rfm_segment string")


def test_arm_relabel_flips_ate(spark):
    df = _arm_frame(spark, [1, 1, 0, 1, 0], [0, 1, 0, 0, 0, 1])
    a = effects.ate_naive(df).first()
    flipped = df.withColumn("treatment_flg", 1 - F.col("treatment_flg"))
    b = effects.ate_naive(flipped).first()
    assert a.ate == pytest.approx(-b.ate) and a.se == pytest.approx(b.se)


def test_cuped_constant_covariate_equals_naive(spark):
    df = _arm_frame(spark, [1, 1, 0, 1, 0], [0, 1, 0, 0, 0, 1]).withColumn("recency_days", F.lit(3))
    a = effects.ate_naive(df).first()
    c = effects.ate_cuped(df, 7).first()
    assert c.theta == 0.0 and c.cuped_ate == pytest.approx(a.ate) and c.cuped_se == pytest.approx(a.se)


def test_empty_arm_segment_left_out(spark):
    df = _arm_frame(spark, [1, 0, 1], [0, 1]).unionByName(_arm_frame(spark, [1, 1, 1], [], seg="champions"))
    out = effects.ate_by_group(df, "rfm_segment", product.SEGMENTS).collect()
    assert [r.segment for r in out] == ["mid"]


def test_constant_covariate_left_out_of_balance_and_fit(spark):
    rng = np.random.default_rng(5)
    n = 200
    pdf = pd.DataFrame({"client_id": np.arange(n), "treatment_flg": rng.integers(0, 2, n),
                        "target": rng.integers(0, 2, n), "x": rng.normal(size=n), "const": np.ones(n)})
    df = spark.createDataFrame(pdf)
    bal = {r.feature for r in validity.covariate_balance(df, ["x", "const"]).collect()}
    assert bal == {"x"}
    res = adjusted_effect(df, ["x", "const"])
    assert res.row("const") == (None, None) and res.rank == 3 and res.row("treatment_flg")[1] > 0


@pytest.mark.parametrize("primary,g1,g2", [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
def test_decision_table(spark, primary, g1, g2):
    df = spark.createDataFrame([(bool(primary), bool(g1), bool(g2))], "p boolean, g1 boolean, g2 boolean")
    d = df.select(effects.decision(F.col("p"), F.col("g1"), F.col("g2")).alias("d")).first().d
    assert d == ("LAUNCH" if primary and g1 and g2 else "HOLD")


def test_guardrails_undefined_share_fails(spark):
    seg = spark.createDataFrame([("mid", 10, -0.1, -0.3, 0.1), ("champions", 10, 0.05, -0.1, 0.2)],
                                "segment string, n long, ate double, ci_lo double, ci_hi double")
    g = effects.guardrails(seg).first()
    assert g.total_incr == pytest.approx(-0.5) and g.champions_incr_share is None and not g.g2_pass
    assert g.g1_pass


@pytest.mark.parametrize("reference, recent, bins, expected", [
    ([1, 2, 3, 4], [1, 2, 3, 4], 2, 0.0),
    ([1, 2, 3, 4], [1, 1, 1, 4], 2, 0.274653),   # shares 1/2, 1/2 against 3/4, 1/4
    ([1, 2, 3, 4], [4, 4, 4, 4], 2, 6.907742),   # an empty bin counts as 1e-6
    ([1, 1, 1, 2], [1, 2, 2, 2], 4, 1.098612),   # edges 1, 1, 1.25: ln 3
])
def test_psi_by_hand(spark, reference, recent, bins, expected):
    rows = [(float(v), "reference") for v in reference] + [(float(v), "recent") for v in recent]
    df = spark.createDataFrame(rows, "score double, period string")
    r = monitoring.psi(df, ["score"], bins=bins).first()
    assert r.psi == pytest.approx(expected, abs=2e-6)
    assert r.flag == ("OK" if expected < 0.1 else "DRIFT")


def test_cutoff_ties_all_targeted(spark):
    rows = [(i, 5.0 if i < 40 else float(i), i % 2, i % 3 == 0, "mid") for i in range(100)]
    df = spark.createDataFrame(rows, "client_id long, score double, treatment_flg int, target boolean, rfm_segment string")
    df = df.withColumn("target", F.col("target").cast("int"))
    t = policy.targeting_policy(df, "score", k=0.7).collect()
    cutoff = t[0].cutoff
    assert cutoff == 5.0 and sum(r.targeted for r in t) == 100  # every tie at the cutoff is in


# ---------------------------------------------------------------- curves against a brute-force numpy version

def _np_curve(y, s, t, kind):
    order = np.argsort(-s, kind="mergesort")
    y, s, t = y[order], s[order], t[order]
    idx = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    nt = np.cumsum(t)[idx].astype(float)
    yt = np.cumsum(y * t)[idx].astype(float)
    yc = np.cumsum(y * (1 - t))[idx].astype(float)
    n = (idx + 1).astype(float)
    nc = n - nt
    d = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b != 0)
    v = (d(yt, nt) - d(yc, nc)) * n if kind == "uplift" else yt - yc * d(nt, nc)
    return np.r_[0, n], np.r_[0, v]


def _np_norm_auc(y, s, t, kind):
    x, v = _np_curve(y, s, t, kind)
    if kind == "qini":
        perfect = y * t - y * (1 - t)
    else:
        cr, tn = np.sum((y == 1) & (t == 0)), np.sum((y == 0) & (t == 1))
        perfect = 2 * (y == t) + (y if cr > tn else t)
    xp, vp = _np_curve(y, perfect.astype(float), t, kind)
    rnd = xp[-1] * vp[-1] / 2
    return (np.trapezoid(v, x) - rnd) / (np.trapezoid(vp, xp) - rnd)


@pytest.mark.parametrize("n,distinct,kw", [(8, 8, {}), (300, 12, {}), (400, 400, {"rows_per_bucket": 37})])
def test_curves_match_brute_force(spark, n, distinct, kw):
    rng = np.random.default_rng(n)
    if n == 8:  # curve_8 fixture
        y = np.array([1, 0, 1, 1, 0, 0, 1, 0]); t = np.array([1, 1, 0, 1, 0, 1, 0, 0])
        s = np.array([0.9, 0.8, 0.8, 0.6, 0.5, 0.4, 0.3, 0.1])
    else:
        y = rng.integers(0, 2, n); t = rng.integers(0, 2, n)
        s = rng.integers(0, distinct, n) / distinct
    pdf = pd.DataFrame({"client_id": np.arange(n), "target": y, "treatment_flg": t, "score": s})
    df = spark.createDataFrame(pdf).repartition(3)
    for kind in ("qini", "uplift"):
        got = curves.normalized_auc(df, "score", kind, kw).first()[f"{kind}_auc"]
        assert got == pytest.approx(_np_norm_auc(y, s.astype(float), t, kind), rel=1e-9, abs=1e-12)
        pts = curves.curve_points(df, "score", kind, kw).toPandas().sort_values("n")
        x, v = _np_curve(y, s.astype(float), t, kind)
        assert np.allclose(pts.n.to_numpy(), x) and np.allclose(pts.value.to_numpy(), v)


def test_decile_table_matches_qcut(spark):
    rng = np.random.default_rng(3)
    n = 237
    pdf = pd.DataFrame({"client_id": np.arange(n), "target": rng.integers(0, 2, n),
                        "treatment_flg": rng.integers(0, 2, n), "score": rng.integers(0, 20, n) / 20})
    df = spark.createDataFrame(pdf)
    got = curves.decile_table(df, "score", {"rows_per_bucket": 50}).toPandas().set_index("decile").sort_index()
    r = pdf.sort_values(["score", "client_id"]).reset_index(drop=True)
    r["decile"] = pd.qcut(pd.Series(np.arange(1, n + 1)), 10, labels=False)
    sizes = r.groupby("decile").size()
    assert got.n.tolist() == sizes.tolist()
    tr = r[r.treatment_flg == 1].groupby("decile").target.mean()
    assert np.allclose(got.treat.to_numpy(), tr.to_numpy())


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_results_unchanged_by_repartitioning(spark, parts):
    """Ranks, segments, deciles and cutoffs depend on keys, not on partitioning."""
    from cartlift.plans.context import Context
    from cartlift.sources.fixtures import fixture_tables
    from cartlift.operators.uplift import train_test_split
    c = Context(spark, "/root/testdata/sf0.001")
    base = c.features
    kw = {"rows_per_bucket": 20}
    ref_seg = {tuple(r) for r in product.rfm_segments(base, kw).collect()}
    moved = base.repartition(parts)
    assert {tuple(r) for r in product.rfm_segments(moved, kw).collect()} == ref_seg
    scored = train_test_split(base, 0.5).withColumn("score", F.coalesce(F.col("n_tx"), F.lit(0)).cast("double"))
    d0 = {tuple(r) for r in curves.decile_table(scored, "score", kw).collect()}
    d1 = {tuple(r) for r in curves.decile_table(scored.repartition(parts), "score", kw).collect()}
    assert d0 == d1
    p0 = policy.targeting_policy(scored, "score", 0.3, kw).select("client_id", "targeted").collect()
    p1 = policy.targeting_policy(scored.repartition(parts), "score", 0.3, kw).select("client_id", "targeted").collect()
    assert set(map(tuple, p0)) == set(map(tuple, p1))
    t = fixture_tables(spark, "/root/testdata/sf0.001")["purchases"]
    r0 = {tuple(r) for r in product.cohort_retention(t).collect()}
    assert {tuple(r) for r in product.cohort_retention(t.repartition(parts)).collect()} == r0


def test_day_arithmetic_is_zone_free(spark):
    """A wall-clock time inside a daylight-saving gap must not move."""
    from cartlift.functions.dates import floor_days
    from cartlift.plans.present import present
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("1995-04-02 02:19:24", "2000-09-01 02:30:04"),
                                    ("2000-06-01 00:30:00", "2000-06-01 01:00:00"),
                                    ("2000-06-01 01:00:00", "2000-06-01 00:00:01")], "a string, b string") \
            .select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
        out = present(df.select("a", floor_days("b", "a").alias("d"))).collect()
        assert [r.d for r in out] == [1979, 0, -1]
        assert out[0].a == "1995-04-02 02:19:24"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
