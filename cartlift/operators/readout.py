"""Adjusted effect and the launch readout (O-43..O-51)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartlift.config import AnalysisConfig
from cartlift.functions.stats import norm_ppf, two_sided_p
from cartlift.operators import effects, ols
from cartlift.operators.product import SEGMENTS
from cartlift.sources.raw import ARM, ID, OUTCOME


def adjusted_effect(df: DataFrame, feature_cols: Sequence[str], approximate_medians: bool = False,
                    rank_kw: dict | None = None) -> ols.OLSResult:
    """ANCOVA: outcome on arm plus median-imputed covariates, HC1 errors (O-43/O-44)."""
    cols = [ARM, *feature_cols]
    mom = ols.column_moments(df, cols)
    fill = ols.impute_medians(df, cols, approximate=approximate_medians, moments=mom,
                              **(rank_kw or {}))
    return ols.ols_hc1(df, OUTCOME, cols, fill, moments=mom)


READOUT_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("ate", T.DoubleType()), ("se", T.DoubleType()), ("pval", T.DoubleType()),
    ("cuped_ate", T.DoubleType()), ("cuped_se", T.DoubleType()), ("cuped_p", T.DoubleType()),
    ("adj_ate", T.DoubleType()), ("adj_se", T.DoubleType()), ("adj_p", T.DoubleType()),
    ("se_reduction", T.DoubleType()), ("sample_saving", T.DoubleType()),
    ("stat_sig", T.BooleanType()), ("practical", T.BooleanType()), ("primary_pass", T.BooleanType()),
    ("g1_pass", T.BooleanType()), ("g2_pass", T.BooleanType()),
    ("champions_incr_share", T.DoubleType()), ("launch", T.BooleanType()), ("decision", T.StringType())]])


def launch_readout(segmented: DataFrame, feature_cols: Sequence[str], cfg: AnalysisConfig,
                   approximate_medians: bool = False) -> DataFrame:
    """One row with the 18 readout fields plus the decision label (O-51).

    The primary estimator is the adjusted one: significant (p < alpha and CI
    above 0) and practical (effect >= practical MDE).  LAUNCH needs the
    primary check and both guardrails.
    """
    # one scan for naive, z-test and CUPED (projections of one moments row)
    m = effects.effect_moments(segmented, cfg.window_days)
    mrow = m.first()
    one = segmented.sparkSession.createDataFrame([mrow], m.schema)
    naive = effects.naive_from(one, cfg.ci_z).first()
    ztest = effects.z_from(one, cfg.alpha).first()
    cuped = effects.cuped_from(one).first()
    seg = effects.ate_by_group(segmented, "rfm_segment", SEGMENTS, cfg.ci_z)
    guard = effects.guardrails(seg, cfg.champ_incr_max).first()
    res = adjusted_effect(segmented, feature_cols, approximate_medians, cfg.rank_kw)
    adj_ate, adj_se = res.row(ARM)
    zq = norm_ppf(1 - cfg.alpha / 2)
    adj_z = adj_ate / adj_se if adj_ate is not None and adj_se else None
    adj_p = two_sided_p(adj_z) if adj_z is not None else None
    ci_lo = adj_ate - zq * adj_se if adj_z is not None else None
    se = naive["se"]
    ratio = (adj_se / se) if adj_se is not None and se else None
    stat_sig = bool(adj_p is not None and adj_p < cfg.alpha and ci_lo > 0)
    practical = bool(adj_ate is not None and adj_ate >= cfg.practical_mde)
    primary = stat_sig and practical
    g1, g2 = bool(guard["g1_pass"]), bool(guard["g2_pass"])
    launch = primary and g1 and g2
    cz = cuped["cuped_z"]
    row = (naive["ate"], se, two_sided_p(ztest["z"]) if ztest["z"] is not None else None,
           cuped["cuped_ate"], cuped["cuped_se"], two_sided_p(cz) if cz is not None else None,
           adj_ate, adj_se, adj_p,
           None if ratio is None else 1 - ratio, None if ratio is None else 1 - ratio * ratio,
           stat_sig, practical, primary, g1, g2, guard["champions_incr_share"], launch,
           "LAUNCH" if launch else "HOLD")
    return segmented.sparkSession.createDataFrame([row], READOUT_SCHEMA)
