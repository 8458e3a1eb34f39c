"""Heterogeneous effects: keyed split and S-/T-learner uplift scores (O-52..O-57).

Scores are ``p(y | x, treated) - p(y | x, control)``.  By default they are
*cross-fitted*: customers are dealt to keyed-hash folds, the models of a fold
are fitted without it and score it alone, so every customer has a score of
models that never saw them and evaluation can use all customers.  The test
split alone (O-52) can be scored instead.

The default learner is a committee of boosted trees fitted in tasks
(:mod:`cartlift.operators.boosting`), all models in one shuffle.  ``spark.ml``
learners that read all rows in distributed passes (``GBTClassifier``, random
forest, logistic regression) are the pluggable alternatives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlift.config import AnalysisConfig
from cartlift.functions.hashing import keyed_uniform
from cartlift.operators.ranking import global_rank
from cartlift.sources.raw import ARM, ID, OUTCOME


def train_test_split(df: DataFrame, test_share: float = 0.3, salt: str = "split",
                     exact: bool = False, **rank_kw) -> DataFrame:
    """Add ``split`` = 'test' / 'train' by a keyed uniform (O-52).

    Default: Bernoulli per customer (u < test_share), stratified by arm in
    expectation and independent of partitioning.  ``exact=True`` takes exactly
    ceil(test_share * n_arm) customers per arm: the lowest keyed uniforms,
    ranked per arm without a single partition.
    """
    u = keyed_uniform(ID, salt)
    if not exact:
        return df.withColumn("split", F.when(u < F.lit(test_share), "test").otherwise("train"))
    ranked = global_rank(df.withColumn("_u", u), [("_u", False)], tie_col=ID, group_cols=[ARM],
                         rank_col="_r", **rank_kw)
    sizes = df.groupBy(ARM).agg(F.ceil(F.count(F.lit(1)) * F.lit(test_share)).alias("_k"))
    return (ranked.join(F.broadcast(sizes), ARM)  # one row per arm
            .withColumn("split", F.when(F.col("_r") <= F.col("_k"), "test").otherwise("train"))
            .drop("_u", "_r", "_k"))


def _base_learner(cfg: AnalysisConfig, features_col: str = "features"):
    """``spark.ml`` base classifier (O-53): boosted depth-limited trees (no L2
    term exists there), a random forest (all trees grown level by level in the
    same passes) or logistic regression."""
    if cfg.learner == "rf":
        return RandomForestClassifier(featuresCol=features_col, labelCol="_label", maxDepth=cfg.learner_depth,
                                      numTrees=cfg.learner_iters, minInstancesPerNode=cfg.learner_min_leaf,
                                      featureSubsetStrategy=cfg.learner_subset, seed=cfg.seed)
    if cfg.learner == "logistic":
        return LogisticRegression(featuresCol=features_col, labelCol="_label", maxIter=100, regParam=0.01,
                                  standardization=True)
    if cfg.learner != "gbt":
        raise ValueError(f"unknown learner {cfg.learner!r}")
    return GBTClassifier(featuresCol=features_col, labelCol="_label", maxDepth=cfg.learner_depth,
                         maxIter=cfg.learner_iters, stepSize=cfg.learner_step,
                         minInstancesPerNode=cfg.learner_min_leaf,
                         featureSubsetStrategy=cfg.learner_subset, seed=cfg.seed)


def missing_bounds(train: DataFrame, feature_cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(below all values, above all values) of each feature that has NULLs in ``train``."""
    row = train.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in feature_cols for n, f in (("lo", F.min), ("hi", F.max))],
                    *[F.count(c).alias(f"n_{c}") for c in feature_cols], F.count(F.lit(1)).alias("_all")).first()
    return {c: ((row[f"lo_{c}"] or 0.0) - 1.0, (row[f"hi_{c}"] or 0.0) + 1.0)
            for c in feature_cols if row[f"n_{c}"] < row["_all"]}


def with_missing_sides(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Nullable features twice, for tree learners that can't read NULLs (O-54):
    ``<c>`` with missing above and ``<c>_lo`` with missing below every value, so
    a tree chooses the side of missing values by the copy that it splits."""
    x = {c: F.col(c).cast("double") for c in bounds}
    return df.withColumns({k: v for c, (lo, hi) in bounds.items() for k, v in
                           ((f"{c}_lo", F.coalesce(x[c], F.lit(lo))), (c, F.coalesce(x[c], F.lit(hi))))})


def _prep_stages(feature_cols: Sequence[str], extra: Sequence[str] = ()) -> list:
    """Assembly of the filled features and their 0/1 missing indicators (O-54)."""
    return [VectorAssembler(inputCols=[*extra, *feature_cols, *[f"_na_{c}" for c in feature_cols]],
                            outputCol="features", handleInvalid="keep")]


def exact_fills(train: DataFrame, feature_cols: Sequence[str]) -> dict[str, float]:
    """Exact medians of the training rows, for the columns that have NULLs
    (O-54): found once and shared by the three fits and by scoring."""
    from cartlift.operators.ols import impute_medians
    return {c: v for c, v in impute_medians(train, feature_cols).items() if v is not None}


def _with_indicators(df: DataFrame, feature_cols: Sequence[str], fills: dict[str, float]) -> DataFrame:
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(float(fills.get(c, 0.0)))).alias(c) for c in feature_cols]
    ind = [F.col(c).isNull().cast("double").alias(f"_na_{c}") for c in feature_cols]
    others = [c for c in df.columns
              if c not in feature_cols and not c.startswith("_na_") and c != "_label"]
    return df.select(*others, *cols, *ind).withColumn("_label", F.col(OUTCOME).cast("double"))


def _score(df: DataFrame, model: PipelineModel, name: str) -> DataFrame:
    """Append p(y=1) as ``name`` and drop the pipeline's work columns (narrow)."""
    before = set(df.columns)
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop(*[c for c in out.columns if c not in before and c != name])


def fit_s_model(train: DataFrame, feature_cols: Sequence[str], cfg: AnalysisConfig,
                fills: dict[str, float]) -> PipelineModel:
    """S-learner: one model with the arm as a feature (O-55)."""
    tr = _with_indicators(train, feature_cols, fills).withColumn("_arm", F.col(ARM).cast("double"))
    return Pipeline(stages=[*_prep_stages(feature_cols, extra=["_arm"]), _base_learner(cfg)]).fit(tr)


def fit_arm_model(train: DataFrame, feature_cols: Sequence[str], cfg: AnalysisConfig,
                  arm: int, fills: dict[str, float]) -> PipelineModel:
    """T-learner half: a model fitted on one arm only (O-56)."""
    tr = _with_indicators(train, feature_cols, fills).where(F.col(ARM) == arm)
    return Pipeline(stages=[*_prep_stages(feature_cols), _base_learner(cfg)]).fit(tr)


def score_s(test: DataFrame, model: PipelineModel, feature_cols: Sequence[str],
            fills: dict[str, float]) -> DataFrame:
    """s_score = p(x, 1) - p(x, 0); both counterfactual predictions are appended
    to the same frame, so scoring adds no shuffle."""
    te = _with_indicators(test, feature_cols, fills)
    te = _score(te.withColumn("_arm", F.lit(1.0)), model, "_p1")
    te = _score(te.withColumn("_arm", F.lit(0.0)), model, "_p0")
    return te.withColumn("s_score", F.col("_p1") - F.col("_p0")).drop("_p1", "_p0", "_arm")


def score_t(test: DataFrame, treated: PipelineModel, control: PipelineModel,
            feature_cols: Sequence[str], fills: dict[str, float]) -> DataFrame:
    """t_score = p_treated(x) - p_control(x)."""
    te = _with_indicators(test, feature_cols, fills)
    te = _score(te, treated, "_pt")
    te = _score(te, control, "_pc")
    return te.withColumn("t_score", F.col("_pt") - F.col("_pc")).drop("_pt", "_pc")


def s_learner(train: DataFrame, test: DataFrame, feature_cols: Sequence[str],
              cfg: AnalysisConfig) -> DataFrame:
    fills = exact_fills(train, feature_cols)
    return score_s(test, fit_s_model(train, feature_cols, cfg, fills), feature_cols, fills)


def t_learner(train: DataFrame, test: DataFrame, feature_cols: Sequence[str],
              cfg: AnalysisConfig) -> DataFrame:
    fills = exact_fills(train, feature_cols)
    return score_t(test, fit_arm_model(train, feature_cols, cfg, 1, fills),
                   fit_arm_model(train, feature_cols, cfg, 0, fills), feature_cols, fills)


# ---------------------------------------------------------------- committees fitted in tasks

FOLD = "fold"
SCORED_PER_TASK = 20_000


def with_folds(df: DataFrame, folds: int, salt: str = "fold") -> DataFrame:
    """Keyed-hash fold 0..folds-1 of each customer."""
    return df.withColumn(FOLD, F.floor(keyed_uniform(ID, salt) * F.lit(folds)).cast("int"))


def _vector(feature_cols: Sequence[str]):
    """Features as one array, NULL and NaN alike as NULL."""
    return F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in feature_cols])


def fit_committees(df: DataFrame, feature_cols: Sequence[str], cfg: AnalysisConfig,
                   scored_folds: Sequence[int]) -> DataFrame:
    """S- and T-learner models of each fold in ``scored_folds``, fitted on the
    rows of all other folds: (model, fold, member, trees), ``model`` being ``s``
    (arm as last feature), ``t`` or ``c``.  One shuffle brings each member its rows.
    Every row is in one member of each model that may read it: members have about
    ``member_rows`` rows, and more where ``members`` of them don't hold all rows."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from cartlift.operators.boosting import boost
    counts = {(r[FOLD], r[ARM]): r["count"] for r in df.groupBy(FOLD, ARM).count().collect()}  # folds x arms
    u = keyed_uniform(ID, "member")
    places, groups = [], 0
    for f in scored_folds:
        for model, arms in (("s", (0, 1)), ("t", (1,)), ("c", (0,))):
            n = sum(k for (fold, arm), k in counts.items() if fold != f and arm in arms)
            dealt = max(1, min(-(-n // cfg.member_rows), cfg.members))
            groups += dealt
            member = F.floor(u * F.lit(dealt)).cast("int")
            places.append(F.when((F.col(FOLD) != f) & F.col(ARM).isin(*arms) & member.isNotNull(),
                                 F.struct(F.lit(model).alias("model"), F.lit(f).alias("scored"), member.alias("member"))))
    rows = (df.select(ID, FOLD, F.col(ARM).cast("double").alias("arm"), F.col(OUTCOME).cast("double").alias("y"),
                      _vector(feature_cols).alias("x"), F.col(ARM))
            .select(F.col(ID).alias("id"), "arm", "y", "x",
                    F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())).alias("to"))
            .select("to.model", F.col("to.scored").alias(FOLD), "to.member", "id", "arm", "y", "x"))
    settings = dict(rounds=cfg.learner_iters, step=cfg.learner_step, depth=cfg.learner_depth, min_leaf=cfg.learner_min_leaf,
                    column_share=float(cfg.learner_subset), l2=cfg.learner_l2)
    width, seed = len(feature_cols), cfg.seed

    def fit(t: pa.Table) -> pa.Table:
        order = pc.sort_indices(t.column("id")).to_numpy()  # sums don't depend on the order of arrival
        place = np.empty(len(t), np.int64)
        place[order] = np.arange(len(t))
        with_arm = t.column("model")[0].as_py() == "s"
        x = np.empty((len(t), width + with_arm))
        at = 0
        for part in t.column("x").chunks:  # no second copy of all features
            x[place[at:at + len(part)], :width] = part.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            at += len(part)
        if with_arm:
            x[place, width] = t.column("arm").to_numpy()
        member = t.column("member")[0].as_py()
        trees = boost(x, t.column("y").to_numpy()[order], seed=seed + member, **settings)
        keys = t.select(["model", FOLD, "member"]).slice(0, 1)
        return keys.append_column("trees", pa.array([trees.dumps()], pa.binary()))

    # a fit is long and its rows are few: partitions go by the number of fits, not by bytes
    spread = max(1, 4 * groups)
    return rows.repartition(spread, "model", FOLD, "member").groupBy("model", FOLD, "member").applyInArrow(
        fit, f"model string, {FOLD} int, member int, trees binary")


def score_committees(df: DataFrame, feature_cols: Sequence[str], models: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns with s_score and t_score; each row meets its own fold's models.
    The models (3 x folds x members at most, some 50 KB each) are sent to all tasks."""
    import numpy as np
    import pyarrow as pa

    from cartlift.operators.boosting import Trees
    # sorted here: a global sort samples its input first, and so would fit every model twice
    fitted = sorted(models.collect(), key=lambda r: (r["model"], r[FOLD], r["member"]))
    packed = [(r["model"], r[FOLD], r["trees"]) for r in fitted]
    sent = df.sparkSession.sparkContext.broadcast(packed)
    width, names = len(feature_cols), list(keep)
    out = T.StructType([*[df.schema[c] for c in names], T.StructField("s_score", T.DoubleType()),
                        T.StructField("t_score", T.DoubleType())])

    def run(batches):
        committees: dict = {}
        for model, fold, data in sent.value:
            committees.setdefault((model, fold), []).append(Trees.loads(data))

        def mean(model: str, fold: int, x):
            own = committees.get((model, fold))
            return sum(t.probability(x) for t in own) / len(own) if own else np.full(len(x), np.nan)

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
            folds = b.column("_fold").to_numpy()
            s, t = np.empty(len(x)), np.empty(len(x))
            for fold in np.unique(folds).tolist():
                own = folds == fold
                part = x[own]
                one, zero = np.ones((len(part), 1)), np.zeros((len(part), 1))
                s[own] = mean("s", fold, np.hstack([part, one])) - mean("s", fold, np.hstack([part, zero]))
                t[own] = mean("t", fold, part) - mean("c", fold, part)
            scores = [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in (s, t)]  # no model: no score
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *scores], names=out.names)

    # a row costs hundreds of tree walks, more than its move: tasks get equal numbers of rows
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SCORED_PER_TASK))
    return (df.select(*names, F.col(FOLD).alias("_fold"), _vector(feature_cols).alias("_x"))
            .repartition(tasks, ID).mapInArrow(run, out))


def cross_fit_scores(df: DataFrame, feature_cols: Sequence[str], cfg: AnalysisConfig,
                     keep: Sequence[str] = (ID, ARM, OUTCOME, "rfm_segment"), fit_source: DataFrame | None = None) -> DataFrame:
    """Every row scored by committees that were fitted without its fold.
    ``fit_source`` (the same customers without segments) lets fits start early."""
    folds = max(2, cfg.learner_folds)
    source = with_folds(df if fit_source is None else fit_source, folds, cfg.fold_salt)
    models = fit_committees(source, feature_cols, cfg, range(folds))
    rows = train_test_split(with_folds(df, folds, cfg.fold_salt), cfg.test_share, cfg.split_salt)
    return score_committees(rows, feature_cols, models, [*keep, "split", FOLD])


def holdout_scores(df: DataFrame, feature_cols: Sequence[str], cfg: AnalysisConfig,
                   keep: Sequence[str] = (ID, ARM, OUTCOME, "rfm_segment"), fit_source: DataFrame | None = None) -> DataFrame:
    """The test split scored by committees that were fitted on the train split."""
    def folded(d: DataFrame) -> DataFrame:
        return (train_test_split(d, cfg.test_share, cfg.split_salt)
                .withColumn(FOLD, F.when(F.col("split") == "test", 0).otherwise(1)))
    models = fit_committees(folded(df if fit_source is None else fit_source), feature_cols, cfg, [0])
    return score_committees(folded(df).where("split = 'test'"), feature_cols, models, [*keep, "split"])


def uplift_scores(segmented: DataFrame, feature_cols: Sequence[str], cfg: AnalysisConfig,
                  fit_source: DataFrame | None = None) -> DataFrame:
    """Scored table (client_id, arm, outcome, rfm_segment, split, s_score, t_score) (O-57):
    all customers with their ``fold`` when cross-fitted, else the test split.
    ``segmented`` may be a callable, evaluated only when scoring needs it."""
    if cfg.learner != "committee":
        return spark_ml_scores(segmented, feature_cols, cfg, fit_source)
    seg = segmented() if callable(segmented) else segmented
    score = cross_fit_scores if cfg.learner_folds > 1 else holdout_scores
    return score(seg, feature_cols, cfg, fit_source=fit_source)


def spark_ml_scores(segmented: DataFrame, feature_cols: Sequence[str], cfg: AnalysisConfig,
                    fit_source: DataFrame | None = None) -> DataFrame:
    """The test split scored by ``spark.ml`` learners.

    ``segmented`` should be a materialised table (the pipeline passes the
    checkpointed customer table): each learner caches its own binned copy of
    the training rows, and the split is a keyed-hash projection of that table.
    ``fit_source`` (the customer table without segments) lets the fits start
    before segmentation finishes: the split depends on ``client_id`` only, so
    both sources give the same training rows; ``segmented`` may then be a
    callable that is evaluated only after the fits.  The three independent
    fits run as concurrent Spark jobs so small-data stages do not leave cores
    idle.
    """
    from concurrent.futures import ThreadPoolExecutor

    def split_of_columns(df: DataFrame, columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
        return (train_test_split(df, cfg.test_share, cfg.split_salt)
                .select(ID, ARM, OUTCOME, *extra, "split", *columns))

    def split_of(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        return split_of_columns(df, list(feature_cols), extra)

    fit_df = split_of(fit_source) if fit_source is not None else None
    if fit_df is None:
        seg_df = segmented() if callable(segmented) else segmented
        fit_df = split_of(seg_df, ["rfm_segment"])
    train = fit_df.where(F.col("split") == "train")
    sides, given = {}, list(feature_cols)
    if cfg.learner in ("gbt", "rf"):
        sides = missing_bounds(train, given)
        train = with_missing_sides(train, sides)
        feature_cols = [*given, *[f"{c}_lo" for c in sides]]
    fills = {} if sides else exact_fills(train, feature_cols)
    sc = train.sparkSession.sparkContext

    def in_pool(fit):
        def run():
            from cartlift.session import LEARNER_POOL
            sc.setLocalProperty("spark.scheduler.pool", LEARNER_POOL)
            return fit()
        return run

    fits = [in_pool(lambda: fit_s_model(train, feature_cols, cfg, fills)),
            in_pool(lambda: fit_arm_model(train, feature_cols, cfg, 1, fills)),
            in_pool(lambda: fit_arm_model(train, feature_cols, cfg, 0, fills))]
    with ThreadPoolExecutor(max_workers=3) as pool:
        s_model, t_model, c_model = [f.result() for f in [pool.submit(fn) for fn in fits]]
    seg_df = segmented() if callable(segmented) else segmented
    test = with_missing_sides(split_of_columns(seg_df, given, ["rfm_segment"]).where(F.col("split") == "test"), sides)
    scored = score_s(test, s_model, feature_cols, fills)
    scored = score_t(scored, t_model, c_model, feature_cols, fills)
    return scored.select(ID, ARM, OUTCOME, "rfm_segment", "split", "s_score", "t_score")
