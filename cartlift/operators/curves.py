"""Uplift evaluation: Qini and uplift curves, normalised AUCs, deciles (O-58..O-64).

Curves have one point per distinct score, cumulated in descending score
order.  Distinct scores can number as many as customers, so the running sums
use :func:`global_cumsum` (bucketed, no single partition).  The trapezoid
area needs each point's predecessor, which is the same running sum minus the
point's own group - no lag across partitions is needed.

Definitions (cumulative N, N_t, N_c = N - N_t, Y_t, Y_c; x/0 taken as 0):
  uplift curve  (Y_t / N_t - Y_c / N_c) * N
  Qini curve    Y_t - Y_c * N_t / N_c
Both start at the origin.  Normalised AUC = (AUC - AUC_random) /
(AUC_perfect - AUC_random); the random curve is the straight line to the last
point.  Perfect Qini ranks by y t - y (1 - t); perfect uplift ranks by
2 [y = t] + (y if #(y=1, t=0) > #(y=0, t=1) else t).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlift.functions.hashing import keyed_uniform
from cartlift.functions.scalars import first_value
from cartlift.operators.ranking import decile_from_rank, global_cumsum, global_rank
from cartlift.sources.raw import ARM, ID, OUTCOME


def _div0(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def curve_value(kind: str, n: Column, nt: Column, yt: Column, yc: Column) -> Column:
    nc = n - nt
    if kind == "uplift":
        return (_div0(yt, nt) - _div0(yc, nc)) * n
    if kind == "qini":
        return yt - yc * _div0(nt, nc)
    raise ValueError(kind)


def score_groups(scored: DataFrame, score: Column) -> DataFrame:
    y, t = F.col(OUTCOME).cast("double"), F.col(ARM).cast("double")
    return scored.groupBy(score.alias("score")).agg(
        F.count(F.lit(1)).cast("double").alias("g_n"), F.sum(t).alias("g_nt"),
        F.sum(y * t).alias("g_yt"), F.sum(y * (1 - t)).alias("g_yc"))


def _cumulate(groups: DataFrame, rank_kw: dict | None) -> DataFrame:
    meas = {"c_n": F.col("g_n"), "c_nt": F.col("g_nt"), "c_yt": F.col("g_yt"), "c_yc": F.col("g_yc")}
    return global_cumsum(groups, [("score", True)], meas, tie_col="score", **(rank_kw or {}))


def curve_points(scored: DataFrame, score_col: str, kind: str = "qini",
                 rank_kw: dict | None = None) -> DataFrame:
    """Curve points (score, n, value) with the origin as a row of NULL score (O-58)."""
    c = _cumulate(score_groups(scored, F.col(score_col).cast("double")), rank_kw)
    pts = c.select("score", F.col("c_n").cast("bigint").alias("n"),
                   curve_value(kind, F.col("c_n"), F.col("c_nt"), F.col("c_yt"), F.col("c_yc")).alias("value"))
    origin = scored.sparkSession.createDataFrame([(None, 0, 0.0)], "score double, n bigint, value double")
    return origin.unionByName(pts)


def _auc(scored: DataFrame, score: Column, kind: str, rank_kw: dict | None) -> DataFrame:
    c = _cumulate(score_groups(scored, score), rank_kw)
    incl = curve_value(kind, F.col("c_n"), F.col("c_nt"), F.col("c_yt"), F.col("c_yc"))
    excl = curve_value(kind, F.col("c_n") - F.col("g_n"), F.col("c_nt") - F.col("g_nt"),
                       F.col("c_yt") - F.col("g_yt"), F.col("c_yc") - F.col("g_yc"))
    return c.agg(F.sum(F.col("g_n") * (incl + excl) / 2).alias("auc"))


def normalized_auc(scored: DataFrame, score_col: str, kind: str = "qini",
                   rank_kw: dict | None = None) -> DataFrame:
    """One row: normalised AUC and its three areas (O-59 Qini, O-60 uplift)."""
    y, t = F.col(OUTCOME).cast("double"), F.col(ARM).cast("double")
    tot = scored.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(t).alias("nt"),
                     F.sum(y * t).alias("yt"), F.sum(y * (1 - t)).alias("yc"),
                     F.sum(y * (1 - t)).alias("cr"), F.sum((1 - y) * t).alias("tn"))
    t_row = tot.select("*", (F.col("n") * curve_value(kind, F.col("n"), F.col("nt"), F.col("yt"), F.col("yc"))
                             / 2).alias("auc_random")).first()
    if kind == "qini":
        perfect = y * t - y * (1 - t)
    else:
        use_y = t_row["cr"] is not None and t_row["tn"] is not None and t_row["cr"] > t_row["tn"]
        perfect = 2 * (y == t).cast("double") + (y if use_y else t)
    # the row count bounds the number of distinct scores: it sizes the
    # ranking buckets without another counting job
    kw = dict(rank_kw or {})
    kw.setdefault("n", int(t_row["n"] or 0))
    actual = first_value(_auc(scored, F.col(score_col).cast("double"), kind, kw))
    best = first_value(_auc(scored, perfect, kind, kw))
    rnd = t_row["auc_random"]
    norm = None
    if None not in (actual, best, rnd) and best != rnd:
        norm = (actual - rnd) / (best - rnd)
    return scored.sparkSession.createDataFrame(
        [(norm, actual, best, rnd)],
        f"{kind}_auc double, auc_actual double, auc_perfect double, auc_random double")


def with_deciles(scored: DataFrame, score_col: str, rank_kw: dict | None = None) -> DataFrame:
    """Equal-size deciles of the score, 0 = lowest, ties by client_id (O-61)."""
    kw = dict(rank_kw or {})
    n = kw.pop("n", None) or scored.count()
    r = global_rank(scored, [(score_col, False)], tie_col=ID, rank_col="_r", n=n, **kw)
    return r.withColumn("decile", decile_from_rank(F.col("_r"), F.lit(n))).drop("_r")


def _rates(by: list[str], df: DataFrame) -> DataFrame:
    y = F.col(OUTCOME).cast("double")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               F.avg(F.when(F.col(ARM) == 1, y)).alias("treat"),
                               F.avg(F.when(F.col(ARM) == 0, y)).alias("control"))


def decile_table(scored: DataFrame, score_col: str, rank_kw: dict | None = None) -> DataFrame:
    """n, treated rate, control rate and uplift in pp per decile (O-62)."""
    d = _rates(["decile"], with_deciles(scored, score_col, rank_kw))
    return d.select("decile", F.concat(F.lit("D"), F.col("decile").cast("string")).alias("decile_label"),
                    "n", "treat", "control", ((F.col("treat") - F.col("control")) * 100).alias("uplift_pp"))


def decile_concentration(deciles: DataFrame) -> DataFrame:
    """Mean uplift of D8-D9 (unweighted) against the n-weighted overall (O-63).

    The overall numerator skips deciles whose uplift is undefined; the
    denominator counts every row.
    """
    a = deciles.agg(F.avg(F.when(F.col("decile") >= 8, F.col("uplift_pp"))).alias("top20_uplift_pp"),
                    F.sum(F.col("uplift_pp") * F.col("n")).alias("_num"), F.sum("n").alias("_den"))
    overall = F.try_divide(F.col("_num"), F.col("_den").cast("double"))
    return a.select("top20_uplift_pp", overall.alias("overall_uplift_pp"),
                    F.try_divide(F.col("top20_uplift_pp"), overall).alias("concentration"))


def learner_evaluation(scored: DataFrame, score_cols: tuple[str, ...] = ("s_score", "t_score"),
                       k: float = 0.30, rank_kw: dict | None = None) -> DataFrame:
    """Qini AUC, uplift AUC and uplift within the top k% of each score, side by
    side on one scored table (one row per score).  Each number is a chain of
    short jobs that leaves cores idle, so the chains run at the same time."""
    from cartlift.functions.scalars import side_by_side
    from cartlift.operators.policy import targeting_policy, uplift_at_k
    chains = [f for c in score_cols for f in (
        lambda c=c: first_value(normalized_auc(scored, c, "qini", rank_kw), "qini_auc"),
        lambda c=c: first_value(normalized_auc(scored, c, "uplift", rank_kw), "uplift_auc"),
        lambda c=c: first_value(uplift_at_k(targeting_policy(scored, c, k, rank_kw), k), "uplift_at_k"))]
    got = side_by_side(chains)
    rows = [(c, *got[3 * i:3 * i + 3]) for i, c in enumerate(score_cols)]
    return scored.sparkSession.createDataFrame(
        rows, "score_col string, qini_auc double, uplift_auc double, uplift_at_k double")


def qini_jackknife(scored: DataFrame, score_col: str, kind: str = "qini", groups: int = 20, salt: str = "jackknife",
                   rank_kw: dict | None = None) -> DataFrame:
    """Normalised AUC of the whole table and its delete-a-group jackknife error.

    Customers are dealt to ``groups`` keyed groups; replicate g leaves group g
    out.  All replicates are curves of one grouped running sum: each row is in
    ``groups - 1`` replicates and the whole, but rows meet as counts per
    (replicate, score).  One row: auc, se, z, groups.
    """
    whole = -1
    y, t = F.col(OUTCOME).cast("double"), F.col(ARM).cast("double")
    dealt = scored.withColumn("_g", F.floor(keyed_uniform(ID, salt) * F.lit(groups)).cast("int"))
    rows = (dealt.select(F.explode(F.sequence(F.lit(whole), F.lit(groups - 1))).alias("rep"), "_g",
                         F.col(score_col).cast("double").alias("score"), y.alias("y"), t.alias("t"))
            .where("rep <> _g"))
    sums = [F.count(F.lit(1)).cast("double").alias("g_n"), F.sum("t").alias("g_nt"),
            F.sum(F.col("y") * F.col("t")).alias("g_yt"), F.sum(F.col("y") * (1 - F.col("t"))).alias("g_yc")]
    totals = rows.groupBy("rep").agg(*sums, F.sum((1 - F.col("y")) * F.col("t")).alias("g_tn")).select(
        "rep", (F.col("g_n") * curve_value(kind, F.col("g_n"), F.col("g_nt"), F.col("g_yt"), F.col("g_yc")) / 2).alias("rnd"),
        (F.col("g_yc") > F.col("g_tn")).alias("use_y"))
    if kind == "qini":
        best = F.col("y") * F.col("t") - F.col("y") * (1 - F.col("t"))
    else:  # which perfect order applies depends on the replicate's totals (groups + 1 rows)
        rows = rows.join(F.broadcast(totals.select("rep", "use_y")), "rep")
        best = 2 * (F.col("y") == F.col("t")).cast("double") + F.when(F.col("use_y"), F.col("y")).otherwise(F.col("t"))
    meas = {f"c_{m}": F.col(f"g_{m}") for m in ("n", "nt", "yt", "yc")}

    def areas(score: Column, name: str, most: int) -> DataFrame:
        per_score = rows.groupBy("rep", score.alias("score")).agg(*sums)
        kw = {"n": most} | (rank_kw or {})  # a bound on the rows saves one more pass over all replicates
        c = global_cumsum(per_score, [("score", True)], meas, tie_col="score", group_cols=["rep"], **kw)
        incl = curve_value(kind, F.col("c_n"), F.col("c_nt"), F.col("c_yt"), F.col("c_yc"))
        excl = curve_value(kind, F.col("c_n") - F.col("g_n"), F.col("c_nt") - F.col("g_nt"),
                           F.col("c_yt") - F.col("g_yt"), F.col("c_yc") - F.col("g_yc"))
        return c.groupBy("rep").agg(F.sum(F.col("g_n") * (incl + excl) / 2).alias(name))

    reps = (areas(F.col("score"), "actual", groups * scored.count())
            .join(areas(best, "perfect", 4 * (groups + 1)), "rep").join(totals, "rep")
            .select("rep", F.try_divide(F.col("actual") - F.col("rnd"), F.col("perfect") - F.col("rnd")).alias("auc")))
    left_out = F.when(F.col("rep") != whole, F.col("auc"))
    k = F.count(left_out)
    se = F.sqrt((k - 1) * F.var_pop(left_out))
    out = reps.agg(F.max(F.when(F.col("rep") == whole, F.col("auc"))).alias("auc"), se.alias("se"), k.alias("groups"))
    return out.select(F.lit(kind).alias("kind"), "auc", "se", F.try_divide(F.col("auc"), F.col("se")).alias("z"), "groups")
