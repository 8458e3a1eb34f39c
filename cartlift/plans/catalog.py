"""Query catalog: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query reads the driver's parquet tables through the fixture views and
runs the engine's operators on them; results pass through :func:`present`
(6-decimal floats, text dates) so they compare with the DuckDB oracles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as _F

from cartlift.plans.present import present
from cartlift.plans.context import Context

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


_shared: dict | None = None


@contextmanager
def shared_contexts() -> Iterator[None]:
    """Within this block queries over one directory share their customer and
    scored tables instead of building them anew (used by tests)."""
    global _shared
    _shared = {}
    try:
        yield
    finally:
        _shared = None


def _context(spark: SparkSession, sf_dir: str) -> Context:
    if _shared is None:
        return Context(spark, sf_dir)
    return _shared.setdefault(sf_dir, Context(spark, sf_dir))


def query(fn: Callable[[Context], DataFrame]):
    name = fn.__name__

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(fn(_context(spark, sf_dir)))

    run.__name__ = name
    run.__doc__ = fn.__doc__
    QUERIES[name] = run
    return fn


# ---------------------------------------------------------------- sources, features
from cartlift.operators import features as feat  # noqa: E402
from cartlift.sources import raw  # noqa: E402


@query
def customer_sample(c: Context) -> DataFrame:
    """O-03: keyed-hash 30% sample of experiment customers."""
    return raw.sample_customers(c.train, 0.3, "sample")


@query
def sampled_purchases(c: Context) -> DataFrame:
    """O-04: purchase lines of the sampled customers (left-semi join)."""
    return raw.sampled_purchases(c.purchases, raw.sample_customers(c.train, 0.3, "sample"))


@query
def transaction_rollup(c: Context) -> DataFrame:
    """O-08: lines -> transactions."""
    return feat.transaction_rollup(c.purchases)


@query
def customer_rollup(c: Context) -> DataFrame:
    """O-09: transactions -> customers."""
    return feat.customer_rollup(feat.transaction_rollup(c.purchases))


@query
def customer_breadth(c: Context) -> DataFrame:
    """O-10: distinct products and stores per customer."""
    return feat.customer_breadth(c.purchases, parts=c.line_parts)


@query
def customer_features(c: Context) -> DataFrame:
    """O-05..O-16: the customer feature table."""
    return c.features_lazy()


# ---------------------------------------------------------------- product analytics
from cartlift.operators import product as prod  # noqa: E402


@query
def core_metrics(c: Context) -> DataFrame:
    """O-18: customers, mean frequency, mean spend, exact median recency."""
    return prod.core_metrics(c.features, c.config.rank_kw)


@query
def time_quality(c: Context) -> DataFrame:
    """O-05/O-22: purchase lines and transactions without a parsable time."""
    return prod.time_quality(c.purchases)


@query
def active_months(c: Context) -> DataFrame:
    """O-20: distinct (customer, month)."""
    return prod.active_months(c.purchases)


@query
def cohort_activity(c: Context) -> DataFrame:
    """O-19..O-21: active customers per acquisition cohort and month offset."""
    return prod.cohort_activity(c.purchases)


@query
def cohort_retention(c: Context) -> DataFrame:
    """O-22: retained share per cohort and offset (long form)."""
    return prod.cohort_retention(c.purchases)


@query
def cohort_matrix(c: Context) -> DataFrame:
    """O-23: latest 6 cohorts by first 6 offsets."""
    from cartlift.session import materialize
    return prod.cohort_matrix(materialize(prod.cohort_retention(c.purchases), "retention"))  # read twice


@query
def rfm_scores(c: Context) -> DataFrame:
    """O-24: R, F, M quintiles (NTILE semantics, distributed)."""
    return prod.rfm_scores(c.features, c.config.rank_kw)


@query
def rfm_segments(c: Context) -> DataFrame:
    """O-24/O-25: quintiles plus segment label."""
    return prod.rfm_segments(c.features, c.config.rank_kw)


@query
def rfm_segment_sizes(c: Context) -> DataFrame:
    """O-27: segment sizes among scored customers."""
    return prod.segment_sizes(prod.rfm_segments(c.features, c.config.rank_kw))


@query
def segment_sizes(c: Context) -> DataFrame:
    """O-26/O-27: segment sizes over all experiment customers (with unknown)."""
    return prod.segment_sizes(c.segmented)


# ---------------------------------------------------------------- experiment validity and effects
from cartlift.operators import effects as eff  # noqa: E402
from cartlift.operators import validity as val  # noqa: E402
from cartlift.operators.features import feature_names  # noqa: E402


@query
def experiment_design(c: Context) -> DataFrame:
    """O-28..O-30: base rate, Cohen's h, required and achievable sizes."""
    k = c.config
    return val.experiment_design(c.features_once, k.window_days, k.mde, k.alpha, k.power)


@query
def experiment_design_by_segment(c: Context) -> DataFrame:
    """O-29/O-30 per RFM segment."""
    k = c.config
    return val.experiment_design(c.segmented, k.window_days, k.mde, k.alpha, k.power, by=["rfm_segment"])


@query
def split_counts(c: Context) -> DataFrame:
    """O-31: customers and share per arm."""
    return val.split_counts(c.train)


@query
def srm(c: Context) -> DataFrame:
    """O-32: chi-square against 50/50 and the p > 0.001 gate."""
    return val.srm(c.train, c.config.srm_ratio, c.config.srm_alpha)


@query
def srm_test(c: Context) -> DataFrame:
    """O-32/O-39: SRM with its p-value."""
    return val.srm_test(c.train, c.config.srm_ratio, c.config.srm_alpha)


@query
def covariate_balance(c: Context) -> DataFrame:
    """O-33: SMD per numeric feature."""
    f = c.features
    return val.covariate_balance(f, feature_names(f), c.config.smd_threshold)


@query
def balance_worst5(c: Context) -> DataFrame:
    """O-34: five largest |SMD|."""
    f = c.features
    return val.worst_balance(val.covariate_balance(f, feature_names(f), c.config.smd_threshold))


@query
def arm_rates(c: Context) -> DataFrame:
    """O-35: outcome rate per arm."""
    return val.arm_rates(c.train)


@query
def ate_naive(c: Context) -> DataFrame:
    """O-36/O-37: difference in rates, unpooled SE, CI."""
    return eff.ate_naive(c.train, c.config.ci_z)


@query
def two_proportion_z(c: Context) -> DataFrame:
    """O-38: pooled two-proportion z-test."""
    return eff.two_proportion_z(c.train, c.config.alpha)


@query
def ate_cuped(c: Context) -> DataFrame:
    """O-40..O-42: CUPED-adjusted effect."""
    return eff.ate_cuped(c.features_once, c.config.window_days)


@query
def ate_by_segment(c: Context) -> DataFrame:
    """O-48: effect per RFM segment."""
    return eff.ate_by_group(c.segmented, "rfm_segment", prod.SEGMENTS, c.config.ci_z)


@query
def guardrails(c: Context) -> DataFrame:
    """O-49/O-50: do-no-harm and champions' incremental share."""
    seg = eff.ate_by_group(c.segmented, "rfm_segment", prod.SEGMENTS, c.config.ci_z)
    return eff.guardrails(seg, c.config.champ_incr_max)


@query
def ate_adjusted(c: Context) -> DataFrame:
    """O-43..O-45: OLS-HC1 coefficient table (arm row = adjusted effect)."""
    from cartlift.operators.readout import adjusted_effect
    f = c.features
    res = adjusted_effect(f, feature_names(f), rank_kw=c.config.rank_kw)
    return res.to_frame(c.spark)


@query
def launch_readout(c: Context) -> DataFrame:
    """O-46..O-51: the 18-field readout and LAUNCH/HOLD."""
    from cartlift.operators.readout import launch_readout as lr
    s = c.segmented
    return lr(s, feature_names(s), c.config)


# ---------------------------------------------------------------- uplift, evaluation, policy, monitoring
from cartlift.operators import curves as cur  # noqa: E402
from cartlift.operators import monitoring as mon  # noqa: E402
from cartlift.operators import policy as pol  # noqa: E402
from cartlift.operators import uplift as upl  # noqa: E402


@query
def train_test_split(c: Context) -> DataFrame:
    """O-52: keyed Bernoulli 70/30 split of experiment customers."""
    return upl.train_test_split(c.train, c.config.test_share, c.config.split_salt).select(
        "client_id", "treatment_flg", "split")


@query
def train_test_split_exact(c: Context) -> DataFrame:
    """O-52 exact-count variant: ceil(30%) per arm by keyed order."""
    return upl.train_test_split(c.train, c.config.test_share, c.config.split_salt, exact=True,
                                **c.config.rank_kw).select("client_id", "treatment_flg", "split")


@query
def uplift_scores(c: Context) -> DataFrame:
    """O-53..O-57: S- and T-learner scores on the test split (GBT)."""
    return c.scored_model


@query
def qini_curve(c: Context) -> DataFrame:
    """O-58: Qini curve points of the fixed score."""
    return cur.curve_points(c.scored_fixed, "score", "qini", c.config.rank_kw)


@query
def uplift_curve(c: Context) -> DataFrame:
    """O-58: uplift curve points of the fixed score."""
    return cur.curve_points(c.scored_fixed, "score", "uplift", c.config.rank_kw)


@query
def qini_auc(c: Context) -> DataFrame:
    """O-59: normalised Qini AUC."""
    return cur.normalized_auc(c.scored_fixed, "score", "qini", c.config.rank_kw)


@query
def uplift_auc(c: Context) -> DataFrame:
    """O-60: normalised uplift AUC."""
    return cur.normalized_auc(c.scored_fixed, "score", "uplift", c.config.rank_kw)


@query
def uplift_deciles(c: Context) -> DataFrame:
    """O-61/O-62: decile table of the fixed score."""
    return cur.decile_table(c.scored_fixed, "score", c.config.rank_kw)


@query
def decile_concentration(c: Context) -> DataFrame:
    """O-63: D8-D9 uplift against the weighted overall."""
    return cur.decile_concentration(cur.decile_table(c.scored_fixed, "score", c.config.rank_kw))


@query
def uplift_at_k(c: Context) -> DataFrame:
    """O-64: uplift within the top 30%."""
    return pol.uplift_at_k(pol.targeting_policy(c.scored_fixed, "score", c.config.k_percent,
                                                c.config.rank_kw), c.config.k_percent)


@query
def targeting_policy(c: Context) -> DataFrame:
    """O-65: cutoff and per-customer targeting flag."""
    return pol.targeting_policy(c.scored_fixed, "score", c.config.k_percent, c.config.rank_kw).select(
        "client_id", "score", "cutoff", "targeted")


@query
def policy_value(c: Context) -> DataFrame:
    """O-66/O-67: uplift in/out of target, separation, captured share."""
    t = pol.targeting_policy(c.scored_fixed, "score", c.config.k_percent, c.config.rank_kw)
    return pol.policy_value(t, c.config.k_percent)


@query
def policy_economics(c: Context) -> DataFrame:
    """O-67 option: net value of the top-30% policy and of treating all
    (unit value 1.0 per incremental response, unit cost 0.01 per send)."""
    t = pol.targeting_policy(c.scored_fixed, "score", c.config.k_percent, c.config.rank_kw)
    return pol.policy_economics(pol.policy_value(t, c.config.k_percent), 1.0, 0.01)


@query
def policy_guardrails(c: Context) -> DataFrame:
    """O-68: champions share and separation guardrails."""
    t = pol.targeting_policy(c.scored_fixed, "score", c.config.k_percent, c.config.rank_kw)
    return pol.policy_guardrails(t)


@query
def psi_drift(c: Context) -> DataFrame:
    """O-69a..c: PSI of the score and key features, reference vs recent half."""
    s = mon.period_halves(c.scored_fixed.join(c.features.select("client_id", "recency_days", "spend_total"),
                                              "client_id"), c.config.period_salt)
    return mon.psi(s, ["score", "recency_days", "spend_total"], bins=c.config.psi_bins,
                   rank_kw=c.config.rank_kw)


@query
def epsilon_assignment(c: Context) -> DataFrame:
    """O-69d: epsilon-greedy action per customer."""
    k = c.config
    return mon.epsilon_assignment(c.scored_fixed, "score", k.epsilon, k.k_percent, k.cycle, k.rank_kw).select(
        "client_id", "score", "cutoff", "action")


@query
def epsilon_buckets(c: Context) -> DataFrame:
    """O-69e: customers per action."""
    k = c.config
    return mon.epsilon_buckets(mon.epsilon_assignment(c.scored_fixed, "score", k.epsilon, k.k_percent,
                                                      k.cycle, k.rank_kw))


@query
def explore_revalidation(c: Context) -> DataFrame:
    """O-69f: effect on the randomised explore slice."""
    k = c.config
    return mon.explore_revalidation(mon.epsilon_assignment(c.scored_fixed, "score", k.epsilon, k.k_percent,
                                                           k.cycle, k.rank_kw))


@query
def learner_evaluation(c: Context) -> DataFrame:
    """O-59/O-60/O-64: Qini, AUUC and uplift@30% of the S- and the T-learner."""
    return cur.learner_evaluation(c.scored_model, k=c.config.k_percent, rank_kw=c.config.rank_kw)


@query
def score_evaluation(c: Context) -> DataFrame:
    """O-59/O-60/O-64: the same evaluation of the fixed score, which SQL can follow."""
    return cur.learner_evaluation(c.scored_fixed, ("score",), c.config.k_percent, c.config.rank_kw)


@query
def scored_rows(c: Context) -> DataFrame:
    """O-52/O-57: what the held-out scored table holds besides the scores."""
    from cartlift.operators.uplift import train_test_split
    split = train_test_split(c.segmented, c.config.test_share, c.config.split_salt)
    return split.where("split = 'test'").select("client_id", "treatment_flg", "target", "rfm_segment", "split")


@query
def cross_fit_rows(c: Context) -> DataFrame:
    """O-52/O-57: what the cross-fitted scored table holds besides the scores."""
    return c.scored_model.select("client_id", "treatment_flg", "target", "rfm_segment", "split", "fold")


@query
def qini_curve_continuous(c: Context) -> DataFrame:
    """O-58: Qini curve of a score that hardly repeats (purchase count plus a keyed uniform)."""
    from cartlift.functions.hashing import keyed_uniform
    scored = c.scored_fixed.withColumn("score", _F.col("score") + keyed_uniform("client_id", "tie"))
    return cur.curve_points(scored, "score", "qini", c.config.rank_kw)


@query
def qini_standard_error(c: Context) -> DataFrame:
    """O-59: Qini AUC of the fixed score with its delete-a-group jackknife error."""
    return cur.qini_jackknife(c.scored_fixed, "score", rank_kw=c.config.rank_kw)


@query
def learner_standard_errors(c: Context) -> DataFrame:
    """O-59/O-60: Qini and uplift AUC of both learners with jackknife errors, cross-fitted and held out."""
    out = None
    for form, scored in (("cross_fit", c.scored_model), ("holdout", c.scored_holdout)):
        for score in ("s_score", "t_score"):
            for kind in ("qini", "uplift"):
                one = cur.qini_jackknife(scored, score, kind, rank_kw=c.config.rank_kw).select(
                    _F.lit(form).alias("form"), _F.lit(score).alias("score_col"), "kind", "auc", "se", "z", "groups")
                out = one if out is None else out.unionByName(one)
    return out


@query
def model_policy_readout(c: Context) -> DataFrame:
    """O-61..O-68 on the T-learner score: policy value, guardrails and decile concentration in one row."""
    from cartlift.functions.scalars import side_by_side
    k, scored = c.config, c.scored_model

    def one_row(p: DataFrame) -> tuple:
        return p.first().asDict(), p.schema.fields

    def policy() -> list[tuple]:
        t = pol.targeting_policy(scored, "t_score", k.k_percent, k.rank_kw)
        return side_by_side([lambda: one_row(pol.policy_value(t, k.k_percent)), lambda: one_row(pol.policy_guardrails(t))])

    def deciles() -> list[tuple]:
        return [one_row(cur.decile_concentration(cur.decile_table(scored, "t_score", k.rank_kw)))]

    row, fields = {}, []
    for own in side_by_side([policy, deciles]):  # three one-row readouts, their jobs at the same time
        for values, names in own:
            row.update(values)
            fields += names
    from pyspark.sql import types as T
    return c.spark.createDataFrame([tuple(row[f.name] for f in fields)], T.StructType(fields))


# ---------------------------------------------------------------- streaming duties (batch form of the same code)
from cartlift.streaming import jobs as stream  # noqa: E402

def _events(c: Context) -> tuple[DataFrame, DataFrame]:
    ev = c.spark.read.parquet(f"{c.sf_dir.rstrip('/')}/events.parquet")
    cut = _F.expr(f"timestamp_ntz'{c.config.events_reference_end}'")
    return ev.where(_F.col("ts") < cut), ev.where(_F.col("ts") >= cut)


@query
def stream_arm_rates(c: Context) -> DataFrame:
    """E-2: events, purchases and purchase rate per day and arm."""
    ev = c.spark.read.parquet(f"{c.sf_dir.rstrip('/')}/events.parquet")
    return stream.windowed_arm_counts(ev)


@query
def stream_srm(c: Context) -> DataFrame:
    """E-2: SRM chi-square of the distinct users of each daily window."""
    ev = c.spark.read.parquet(f"{c.sf_dir.rstrip('/')}/events.parquet")
    return stream.window_srm(stream.window_users(ev))


@query
def stream_psi(c: Context) -> DataFrame:
    """E-1: daily PSI of the incoming value against first-week reference edges."""
    ref, cur = _events(c)
    edges = stream.reference_edges(ref, "value")
    return stream.windowed_psi(stream.windowed_bins(cur, edges), stream.reference_shares(ref, edges))


@query
def stream_assignment(c: Context) -> DataFrame:
    """E-3: epsilon-greedy action at arrival with a reference top-30% cutoff."""
    ref, cur = _events(c)
    from cartlift.operators.ranking import exact_quantiles
    cutoff = exact_quantiles(ref, "value", [1.0 - c.config.k_percent]).first()["value"]
    return stream.assign_at_arrival(cur, cutoff, c.config.epsilon, c.config.cycle).select(
        "event_id", "user_id", "action")


@query
def aa_test(c: Context) -> DataFrame:
    """E-4: naive effect between two keyed halves of the control arm."""
    return stream.aa_test(c.train)


# ---------------------------------------------------------------- decision ledger over two cycles of events
from cartlift.operators import ledger as led  # noqa: E402

LEDGER_EPSILON = 0.2  # the fixture's users are few: a larger slice than the policy's 5%


def _ledger(c: Context) -> DataFrame:
    ev = c.spark.read.parquet(f"{c.sf_dir.rstrip('/')}/events.parquet")
    return led.ledger(ev, c.config.events_reference_end, cycles=2, epsilon=LEDGER_EPSILON, k=c.config.k_percent)


@query
def sticky_assignment(c: Context) -> DataFrame:
    """E-3/O-69d: action of each user's first event in a cycle, which holds for the cycle."""
    ev = c.spark.read.parquet(f"{c.sf_dir.rstrip('/')}/events.parquet")
    numbered = led.with_cycle(ev, c.config.events_reference_end, 7).where("cycle >= -1")
    return led.first_decisions(numbered.where("cycle >= 0"), led.cycle_cutoffs(numbered, c.config.k_percent),
                               c.config.epsilon).select("user_id", "cycle", "event_id", "action", "p_treat")


@query
def cycle_ledger(c: Context) -> DataFrame:
    """O-69f: every decision of two cycles with the response of the seven days after it."""
    return _ledger(c).select("user_id", "cycle", "event_id", "value", "cutoff", "action", "p_treat", "target")


@query
def cycle_rates(c: Context) -> DataFrame:
    """O-69f: response rate per cycle and action."""
    return led.ledger_rates(_ledger(c))


@query
def cycle_explore_deciles(c: Context) -> DataFrame:
    """O-69f/O-62: decile table of the explore slice on the next cycle's outcomes."""
    return led.explore_deciles(_ledger(c), rank_kw=c.config.rank_kw)


@query
def cycle_weighted_effect(c: Context) -> DataFrame:
    """O-69f: inverse-propensity effect per cycle and pooled."""
    return led.weighted_effect(_ledger(c))


# ---------------------------------------------------------------- drift cube
from cartlift.operators import drift  # noqa: E402

DRIFT_COLUMNS = ("purchase_sum", "regular_points_received", "trn_sum_from_iss")
DRIFT_MONTHS = [f"2000-{m:02d}" for m in range(1, 13)]


def _drift(c: Context) -> tuple[DataFrame, DataFrame]:
    """Counts of three line columns in each month of 2000, in the deciles of January."""
    lines = c.purchases.where(_F.year("transaction_datetime") == 2000)
    month = _F.substring(_F.col("transaction_datetime").cast("string"), 1, 7)
    profile = drift.reference_profile(lines.where(month == DRIFT_MONTHS[0]), DRIFT_COLUMNS, rank_kw=c.config.rank_kw)
    return drift.bin_counts(lines, DRIFT_COLUMNS, month, profile), profile


@query
def drift_cube(c: Context) -> DataFrame:
    """O-69a/E-1: PSI of three columns in twelve months against the profile of the first."""
    return drift.psi_against_profile(*_drift(c))


@query
def drift_between_months(c: Context) -> DataFrame:
    """O-69a: PSI of each month against the month before, from the same counts."""
    pairs = c.spark.createDataFrame(list(zip(DRIFT_MONTHS[1:], DRIFT_MONTHS)), "period string, reference string")
    return drift.psi_between(*_drift(c), pairs)


@query
def sketch_cutoff(c: Context) -> DataFrame:
    """O-65: top-30% cutoff of event values, exact, beside the merged daily
    sketches': whether the sketch's cutoff keeps twice its 99% rank error."""
    from cartlift.operators import sketches as sk
    from cartlift.operators.ranking import exact_quantiles
    ev = c.spark.read.parquet(f"{c.sf_dir.rstrip('/')}/events.parquet")
    p = 1.0 - c.config.k_percent
    daily = sk.daily_sketches(ev, "value", _F.to_date("ts"))
    got = sk.merged_quantiles(daily, [p]).first()
    exact = exact_quantiles(ev, "value", [p]).first()["value"]
    tolerance = 2 * sk.rank_error()
    check = sk.rank_check(ev, "value", got["value"], p, tolerance)
    return check.select(_F.lit(daily.count()).alias("days"), "n", _F.lit(exact).alias("cutoff_exact"),
                        _F.lit(tolerance).alias("rank_tolerance"), "within")


# ---------------------------------------------------------------- landing of text files
def _landed(c: Context) -> str:
    """Root of a landing of the purchase lines, written as CSV text with planted
    faults by transaction: cut and overlong lines, a text amount, a missing
    client, an unparsable time."""
    import uuid

    from cartlift.session import ensure_checkpoint_dir
    from cartlift.sources import landing
    root = f"{ensure_checkpoint_dir(c.spark).rstrip('/')}/landing-{uuid.uuid4().hex}"
    fault = _F.col("transaction_id") % 101

    def field(name: str):
        x = _F.lit("1.0") if name == "product_quantity" else _F.coalesce(_F.col(name).cast("string"), _F.lit(""))
        bad = {"client_id": (2, ""), "transaction_datetime": (3, "not a date"), "purchase_sum": (1, "n/a")}.get(name)
        return x if bad is None else _F.when(fault == bad[0], bad[1]).otherwise(x)

    fields = [field(f.name) for f in raw.PURCHASES_CSV_SCHEMA.fields]
    line = (_F.when(fault == 0, _F.concat_ws(",", *fields[:3])).when(fault == 4, _F.concat_ws(",", *fields, _F.lit("extra")))
            .otherwise(_F.concat_ws(",", *fields)))
    c.purchases.select(line.alias("value")).write.text(f"{root}/source")
    landing.land(c.spark, f"{root}/source", f"{root}/table", raw.PURCHASES_CSV_SCHEMA, ("transaction_datetime",), header=False)
    return f"{root}/table"


@query
def landed_purchases(c: Context) -> DataFrame:
    """O-01/O-05: purchase lines landed from text; broken ones are set aside, bad times are NULL."""
    from cartlift.sources import landing
    return landing.landed(c.spark, _landed(c), raw.PURCHASES_CSV_SCHEMA).select(
        "client_id", "transaction_id", "transaction_datetime", "purchase_sum", "product_id", "store_id", "trn_sum_from_red")


@query
def landing_report(c: Context) -> DataFrame:
    """O-01: lines landed and set aside, by reason."""
    from cartlift.sources import landing
    return landing.landing_report(c.spark, _landed(c))


@query
def stream_running_srm(c: Context) -> DataFrame:
    """E-2: sample-ratio test of the distinct users so far, valid at every daily look."""
    from cartlift.operators import sequential
    ev = c.spark.read.parquet(f"{c.sf_dir.rstrip('/')}/events.parquet")
    return sequential.running_srm(sequential.first_windows(stream.window_users(ev)))


@query
def merged_purchase_features(c: Context) -> DataFrame:
    """O-06..O-12: purchase features from the merged states of two halves of the history."""
    from cartlift.functions.scalars import first_value, ntz_lit
    from cartlift.operators import state
    early = _F.col("transaction_datetime") < _F.expr("timestamp_ntz'1998-06-01'")
    halves = [state.basket_rollup(c.purchases.where(h)) for h in (early, ~early)]
    sums = state.merge_sums(*[state.customer_sums(h) for h in halves])
    held = state.merge_presence(*[state.presence(h) for h in halves])
    latest = ntz_lit(first_value(sums.agg(_F.max("last_tx"))))
    return state.features_from_state(sums, held, latest)
