"""Trees fitted in tasks, and cross-fitted scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlift.config import AnalysisConfig
from cartlift.operators import uplift as U
from cartlift.operators.boosting import Trees, bin_edges, boost

FAST = AnalysisConfig(learner_iters=40, learner_step=0.2, learner_folds=3)


def auc(score, y):
    r = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    n1 = y.sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_edges_and_missing_bin():
    x = np.array([1.0, 1, 1, 2, 3, np.nan])
    assert bin_edges(x).tolist() == [1.0, 2.0]
    assert bin_edges(np.array([np.nan, np.nan])).tolist() == []
    many = bin_edges(np.arange(10_000.0))
    assert len(many) == 62 and many.max() < 9_999


def test_first_split_and_leaf_are_the_newton_step():
    """One tree of depth 1 against the closed form."""
    x = np.array([[0.0]] * 60 + [[1.0]] * 40)
    y = np.array([0.0] * 50 + [1.0] * 10 + [1.0] * 30 + [0.0] * 10)
    t = boost(x, y, rounds=1, step=0.5, depth=1, column_share=1.0, l2=1.0)
    p = y.mean()
    g, h = p - y, np.full(100, p * (1 - p))
    want = [-0.5 * g[s].sum() / (h[s].sum() + 1) for s in (slice(0, 60), slice(60, 100))]
    assert np.allclose(t.leaf[0], want) and t.cut[0, 0] == 0.0
    assert np.allclose(t.probability(x), 1 / (1 + np.exp(-(np.log(p / (1 - p)) + np.repeat(want, [60, 40])))))


def test_min_leaf_and_no_split():
    x, y = np.arange(50.0)[:, None], (np.arange(50) > 24).astype(float)
    t = boost(x, y, rounds=3, min_leaf=30)
    assert np.isinf(t.cut).all() and np.allclose(t.probability(x), 0.5)
    empty = boost(np.zeros((0, 2)), np.zeros(0), rounds=2)
    assert np.allclose(empty.probability(np.zeros((3, 2))), 0.5)


def planted_missing(n=4000, seed=3):
    """Missing means high risk on a, low risk on b."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    ma, mb = rng.random(n) < 0.3, rng.random(n) < 0.3
    logit = np.where(ma, 1.5, a * 0.7) + np.where(mb, -1.5, b * 0.7)
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(float)
    x = np.column_stack([np.where(ma, np.nan, a), np.where(mb, np.nan, b)])
    return x, y, logit


def test_missing_values_choose_their_side():
    x, y, logit = planted_missing()
    tree = boost(x, y, rounds=60, step=0.1, column_share=1.0)
    p = tree.probability(x)
    assert auc(p, y) > auc(logit, y) - 0.01
    ma, mb = np.isnan(x).T
    assert p[ma].mean() > p[~ma].mean() + 0.1 and p[mb].mean() < p[~mb].mean() - 0.1
    sides = {(f, m) for f, m, c in zip(tree.feature.ravel(), tree.missing_left.ravel(), tree.cut.ravel()) if np.isfinite(c)}
    assert (0, False) in sides and (1, True) in sides
    again = Trees.loads(tree.dumps())
    assert np.array_equal(again.probability(x), p)


def test_missing_sides_for_spark_trees(spark):
    """The two copies of a column let spark.ml trees rank the planted table too,
    as well as a median fill with a flag (a continuous column's median is a
    value of its own, which trees can cut out, so the fill is no bad rival)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    x, y, logit = planted_missing(1500)
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")

    def rank(frame, cols):
        v = VectorAssembler(inputCols=cols, outputCol="features").transform(frame)
        m = GBTClassifier(labelCol="y", maxDepth=3, maxIter=8, stepSize=0.3, seed=1).fit(v)
        got = m.transform(v).select("id", vector_to_array("probability")[1].alias("p")).orderBy("id").collect()
        return auc(np.array([r.p for r in got]), y)

    bounds = U.missing_bounds(df, ["a", "b"])
    sides = rank(U.with_missing_sides(df, bounds), ["a", "a_lo", "b", "b_lo"])
    median = df.fillna({c: float(np.nanmedian(x[:, j])) for j, c in enumerate("ab")})
    flags = median.join(df.select("id", F.col("a").isNull().cast("double").alias("na"), F.col("b").isNull().cast("double").alias("nb")), "id")
    best = auc(logit, y)
    assert sides > best - 0.03
    assert abs(rank(flags, ["a", "b", "na", "nb"]) - sides) < 0.02


def table(spark, n=900):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        a, b = float(rng.normal()), None if rng.random() < 0.2 else float(rng.normal())
        t = int(rng.random() < 0.5)
        p = 0.3 + 0.4 * t * (a > 0)
        rows.append((i, t, int(rng.random() < p), "mid", a, b))
    return spark.createDataFrame(rows, "client_id int, treatment_flg int, target int, rfm_segment string, a double, b double").repartition(3)


def scores(df):
    return {r.client_id: (r.fold, r.s_score, r.t_score) for r in df.collect()}


def test_cross_fitting_never_reads_its_own_fold(spark):
    df = table(spark).cache()
    base = scores(U.cross_fit_scores(df, ["a", "b"], FAST))
    assert len(base) == 900 and {v[0] for v in base.values()} == {0, 1, 2}
    flipped = U.with_folds(df, 3).withColumn("target", F.when(F.col("fold") == 0, 1 - F.col("target")).otherwise(F.col("target"))).drop("fold")
    other = scores(U.cross_fit_scores(flipped, ["a", "b"], FAST))
    assert all(base[c] == other[c] for c in base if base[c][0] == 0)
    assert any(base[c] != other[c] for c in base if base[c][0] != 0)


def test_scores_rank_the_planted_effect_and_dont_depend_on_partitions(spark):
    df = table(spark)
    got = scores(U.cross_fit_scores(df, ["a", "b"], FAST))
    a = {r.client_id: r.a for r in df.collect()}
    for k in (1, 2):
        high = np.mean([v[k] for c, v in got.items() if a[c] > 0.3])
        low = np.mean([v[k] for c, v in got.items() if a[c] < -0.3])
        assert high > low + 0.15
    assert got == scores(U.cross_fit_scores(df.repartition(7), ["a", "b"], FAST))


def test_members_bound_the_rows_of_a_model(spark):
    df = U.with_folds(table(spark), 2)
    cfg = FAST.with_(member_rows=60, members=3)
    models = U.fit_committees(df, ["a", "b"], cfg, [0, 1]).collect()
    assert {(m.model, m.fold, m.member) for m in models} == {(x, f, k) for x in "stc" for f in (0, 1) for k in range(3)}


def test_holdout_scores_the_test_split(spark):
    df = table(spark)
    got = U.holdout_scores(df, ["a", "b"], FAST)
    assert got.columns == ["client_id", "treatment_flg", "target", "rfm_segment", "split", "s_score", "t_score"]
    assert got.count() == U.train_test_split(df, 0.3, "split").where("split = 'test'").count()


def test_edge_tables(spark):
    one_arm = table(spark, 60).where("treatment_flg = 1")
    rows = U.cross_fit_scores(one_arm, ["a", "b"], FAST).collect()
    assert rows and all(r.t_score is None and r.s_score is not None for r in rows)
    assert U.cross_fit_scores(one_arm.limit(0), ["a", "b"], FAST).count() == 0


@pytest.mark.parametrize("learner", ["gbt", "logistic"])
def test_spark_ml_learners_still_score_the_test_split(spark, learner):
    df = table(spark, 400)
    got = U.uplift_scores(df, ["a", "b"], FAST.with_(learner=learner, learner_iters=3))
    assert {"s_score", "t_score", "split"} <= set(got.columns) and got.count() > 50


def plain_walk(t, x):
    """Every tree of every row, node by node."""
    inner, out = t.feature.shape[1], []
    for row in x:
        leaves = []
        for k in range(len(t.feature)):
            node = 0
            while node < inner:
                v = row[t.feature[k, node]]
                left = t.missing_left[k, node] if np.isnan(v) else v <= t.cut[k, node]
                node = 2 * node + (1 if left else 2)
            leaves.append(t.leaf[k, node - inner])
        out.append(1 / (1 + np.exp(-(t.base + np.sum(leaves)))))
    return np.array(out)


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_probability_is_a_walk_through_every_tree(depth):
    x, y, _ = planted_missing(1200)
    x[:3] = [[np.inf, -np.inf], [np.nan, np.nan], [-np.inf, 0.0]]
    t = boost(x, y, rounds=45, step=0.2, depth=depth, column_share=1.0)
    p = t.probability(x, rows=500, trees_at_once=7)
    assert np.allclose(p, plain_walk(t, x), rtol=1e-12) and np.array_equal(p, t.probability(x))


def test_rows_are_counted_where_a_small_leaf_would_win():
    """A pure segment of fewer rows than a leaf may have is the best split of all."""
    x = np.concatenate([np.zeros(20), np.ones(200), np.full(200, 2.0)])[:, None]
    y = np.concatenate([np.ones(20), np.zeros(160), np.ones(40), np.zeros(120), np.ones(80)])
    free, bound = (boost(x, y, rounds=1, depth=1, column_share=1.0, min_leaf=m) for m in (1, 30))
    assert free.cut[0, 0] == 0.0 and bound.cut[0, 0] == 1.0


def test_models_are_fitted_once(spark, tmp_path):
    df = table(spark, 300)
    rows = U.with_folds(df, 2)
    models = U.fit_committees(rows, ["a", "b"], FAST, [0, 1])

    def noted(batches):
        import uuid
        for b in batches:
            for _ in range(b.num_rows):
                (tmp_path / uuid.uuid4().hex).touch()
            yield b

    scored = U.score_committees(rows, ["a", "b"], models.mapInArrow(noted, models.schema), ["client_id"])
    assert scored.count() == 300 and len(list(tmp_path.iterdir())) == 6


def counted_fits(monkeypatch, tmp_path):
    """Fits that note the numbers of their rows, one file a fit, in place of boosting 500 rounds."""
    real = boost

    def noted(x, y, **settings):
        import uuid
        assert len(x) == len(y)
        (tmp_path / f"{uuid.uuid4().hex}-{len(x)}").touch()
        return real(x, y, **{**settings, "rounds": 2})
    monkeypatch.setattr("cartlift.operators.boosting.boost", noted)
    return lambda: sorted(int(p.name.split("-")[1]) for p in tmp_path.iterdir())


def test_uplift_scores_are_of_models_that_read_all_rows(spark, monkeypatch, tmp_path):
    """more rows than members x member_rows are all fitted, and rows without an id are not."""
    df = table(spark)
    fitted = counted_fits(monkeypatch, tmp_path)
    cfg = FAST.with_(member_rows=60, members=3)
    assert U.uplift_scores(df, ["a", "b"], cfg).count() == 900
    # each row is in one member of the S model and of its arm's model, in every fold but its own
    assert len(fitted()) == 3 * 3 * cfg.learner_folds and sum(fitted()) == 2 * (cfg.learner_folds - 1) * 900
    known = U.fit_committees(U.with_folds(df.withColumn("client_id", F.expr("nullif(client_id, 7)")), 2), ["a", "b"], cfg, [0, 1])
    assert known.where("member is null").count() == 0


def all_rows_of_sf0001(spark, monkeypatch, tmp_path, name):
    """(rows of the fits, customers, train rows) of a catalog query whose models have more rows than members x member_rows."""
    from cartlift.plans import catalog
    from cartlift.plans.context import Context
    c = Context(spark, "/root/testdata/sf0.001")
    c.config = c.config.with_(learner_iters=2, member_rows=10, members=2)
    fitted = counted_fits(monkeypatch, tmp_path)
    assert getattr(catalog, name)(c).count() >= 1
    train = U.train_test_split(c.segmented, c.config.test_share, c.config.split_salt).where("split = 'train'")
    return sum(fitted()), c.segmented.count(), train.count()


def test_learner_evaluation_is_of_models_that_read_all_rows(spark, monkeypatch, tmp_path):
    """each row in the S model and its arm's, in 4 of 5 folds."""
    fitted, customers, _ = all_rows_of_sf0001(spark, monkeypatch, tmp_path, "learner_evaluation")
    assert fitted == 8 * customers


def test_learner_standard_errors_are_of_models_that_read_all_rows(spark, monkeypatch, tmp_path):
    """cross-fitted as F2, and held out: each train row in the S model and its arm's."""
    fitted, customers, train = all_rows_of_sf0001(spark, monkeypatch, tmp_path, "learner_standard_errors")
    assert fitted == 8 * customers + 2 * train


def test_model_policy_readout_is_of_models_that_read_all_rows(spark, monkeypatch, tmp_path):
    """as F2."""
    fitted, customers, _ = all_rows_of_sf0001(spark, monkeypatch, tmp_path, "model_policy_readout")
    assert fitted == 8 * customers
