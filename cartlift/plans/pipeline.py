"""End-to-end run: load -> features -> analytics -> experiment -> uplift -> policy -> monitoring.

All outputs are DataFrames.  The customer table (read by about ten
operators) and the scored test table are checkpointed into the shared
checkpoint folder, so every later job starts from them instead of the
purchase scan, and a lost executor re-reads them instead of recomputing.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from cartlift.config import AnalysisConfig
from cartlift.operators import curves, effects, monitoring, policy, product, validity
from cartlift.operators.features import customer_features, feature_names
from cartlift.operators.readout import launch_readout
from cartlift.operators.uplift import uplift_scores
from cartlift.session import drop_tables, materialize, written_tables
from cartlift.sources.publish import publish_run
from cartlift.sources.raw import load_tables, sample_customers, sampled_purchases, write_tables


class Run:
    """Lazily built, memoised pipeline outputs."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], config: AnalysisConfig,
                 as_of=None, gender_cats=None, score_col: str = "t_score",
                 land_sources: bool | str = False):
        """``land_sources`` is for inputs that are derived views (joins) rather
        than plain table scans - the purchases are read by four branches
        (transaction rollup, breadth, reference time, cohorts):
        ``True``/``"parquet"`` writes them once as Parquet in the shared
        checkpoint folder (a lineage cut); ``"cache"`` keeps them in Spark's
        columnar cache (memory, spilling to disk; a lost block is recomputed
        from the view)."""
        if land_sources in (True, "parquet"):
            tables = {k: materialize(v, name=k) for k, v in tables.items()}
        elif land_sources == "cache":
            from pyspark import StorageLevel
            tables = {k: v.persist(StorageLevel.MEMORY_AND_DISK) for k, v in tables.items()}
        self.spark, self.t, self.cfg = spark, tables, config
        self.as_of, self.gender_cats, self.score_col = as_of, gender_cats, score_col
        self._memo: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()

    def _get(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Build a shared table once, also when several threads ask for it."""
        with self._guard:
            lock = self._locks.setdefault(name, threading.Lock())
        with lock:
            if name not in self._memo:
                self._memo[name] = build()
        return self._memo[name]

    # product analytics
    def features(self) -> DataFrame:
        return self._get("customer_features", lambda: materialize(customer_features(
            self.t["train"], self.t["clients"], self.t["purchases"], self.as_of, self.gender_cats,
            self.cfg.null_future_dates, self.cfg.approximate_breadth)))

    def segmented(self) -> DataFrame:
        return self._get("segmented", lambda: materialize(
            product.attach_segments(self.features(), self.cfg.rank_kw)))

    def feature_cols(self) -> list[str]:
        return feature_names(self.features())

    def outputs(self) -> dict[str, Callable[[], DataFrame]]:
        c, seg = self.cfg, self.segmented
        scored = lambda: self._get("uplift_scores", lambda: materialize(
            uplift_scores(seg, self.feature_cols(), c, fit_source=self.features())))
        targeted = lambda: self._get("targeted", lambda: policy.targeting_policy(
            scored(), self.score_col, c.k_percent, c.rank_kw, c.approximate_cutoffs))
        assigned = lambda: self._get("assigned", lambda: monitoring.epsilon_assignment(
            scored(), self.score_col, c.epsilon, c.k_percent, c.cycle, c.rank_kw, c.approximate_cutoffs))
        deciles = lambda: self._get("deciles", lambda: materialize(curves.decile_table(
            scored(), self.score_col, c.rank_kw)))
        retention = lambda: self._get("retention", lambda: materialize(
            product.cohort_retention(self.t["purchases"])))
        return {
            "customer_features": self.features,
            "core_metrics": lambda: product.core_metrics(self.features(), c.rank_kw),
            "cohort_retention": retention,
            "cohort_matrix": lambda: product.cohort_matrix(retention()),
            "segment_sizes": lambda: product.segment_sizes(seg()),
            "experiment_design": lambda: validity.experiment_design(
                self.features(), c.window_days, c.mde, c.alpha, c.power),
            "split_counts": lambda: validity.split_counts(self.t["train"]),
            "srm": lambda: validity.srm_test(self.t["train"], c.srm_ratio, c.srm_alpha),
            "covariate_balance": lambda: validity.covariate_balance(
                self.features(), self.feature_cols(), c.smd_threshold),
            "balance_worst5": lambda: validity.worst_balance(validity.covariate_balance(
                self.features(), self.feature_cols(), c.smd_threshold)),
            "arm_rates": lambda: validity.arm_rates(self.features()),
            "ate_by_segment": lambda: effects.ate_by_group(seg(), "rfm_segment", product.SEGMENTS, c.ci_z),
            "launch_readout": lambda: launch_readout(seg(), feature_names(seg()), c, c.approximate_medians),
            "uplift_scores": scored,
            "learner_evaluation": lambda: curves.learner_evaluation(scored(), k=c.k_percent, rank_kw=c.rank_kw),
            "uplift_deciles": deciles,
            "decile_concentration": lambda: curves.decile_concentration(deciles()),
            "qini_auc": lambda: curves.normalized_auc(scored(), self.score_col, "qini", c.rank_kw),
            "uplift_auc": lambda: curves.normalized_auc(scored(), self.score_col, "uplift", c.rank_kw),
            "policy_value": lambda: policy.policy_value(targeted(), c.k_percent),
            "uplift_at_k": lambda: policy.uplift_at_k(targeted(), c.k_percent),
            "policy_economics": lambda: policy.policy_economics(
                policy.policy_value(targeted(), c.k_percent), c.unit_value, c.unit_cost),
            "policy_guardrails": lambda: policy.policy_guardrails(targeted()),
            "psi_drift": lambda: monitoring.psi(
                monitoring.period_halves(scored().join(self.features().select("client_id", *c.key_features), "client_id"),
                                         c.period_salt),
                [self.score_col, *c.key_features], bins=c.psi_bins, rank_kw=c.rank_kw),
            "epsilon_buckets": lambda: monitoring.epsilon_buckets(assigned()),
            "explore_share": lambda: monitoring.explore_share(assigned()),
            "explore_revalidation": lambda: monitoring.explore_revalidation(assigned()),
        }


def run(spark: SparkSession, tables: dict[str, DataFrame], config: AnalysisConfig | None = None,
        **kw) -> dict[str, DataFrame]:
    """Build every output (lazy except the checkpointed tables)."""
    r = Run(spark, tables, config or AnalysisConfig(), **kw)
    return {name: build() for name, build in r.outputs().items()}


def run_from_paths(spark: SparkSession, paths: dict[str, str], out: str, config: AnalysisConfig | None = None,
                   fmt: str = "parquet", run_date: str | None = None, **kw) -> list[str]:
    """From source files to written result tables; returns the tables' names.

    Reads ``train``, ``clients`` and ``purchases`` from ``paths``, keeps a
    keyed sample of the customers if ``sample_frac`` is set, writes every
    output under ``out/<name>`` and drops the intermediate tables.  With
    ``run_date`` the outputs are published as one dated run
    (:mod:`cartlift.sources.publish`): all of them become visible at once.
    """
    config = config or AnalysisConfig()
    mark = written_tables()
    try:
        train, clients, purchases = load_tables(spark, paths, fmt)
        if config.sample_frac is not None:
            train = sample_customers(train, config.sample_frac, config.sample_salt)
            purchases = sampled_purchases(purchases, train)
        r = Run(spark, {"train": train, "clients": clients, "purchases": purchases}, config, **kw)
        if run_date is not None:
            outputs = r.outputs()
            publish_run(spark, outputs, out, run_date)
            return list(outputs)
        names = []
        for name, build in r.outputs().items():
            write_tables({name: build()}, out)
            names.append(name)
        return names
    finally:
        drop_tables(spark, mark)


def timed_run(spark: SparkSession, tables: dict[str, DataFrame], config: AnalysisConfig | None = None,
              jobs: dict[str, int] | None = None, parallel: int = 1, **kw) -> dict[str, float]:
    """Run every output to completion and return wall seconds per output.

    Tables are evaluated with the ``noop`` sink (full execution, nothing
    collected); readouts are collected (a few rows each).  With
    ``parallel > 1`` the outputs are submitted from that many driver threads
    once the shared customer table exists (FAIR scheduling); the per-output
    seconds then overlap and include waiting for shared tables.
    """
    t0 = time.perf_counter()
    r = Run(spark, tables, config or AnalysisConfig(), **kw)
    times: dict[str, float] = {"land_sources": time.perf_counter() - t0} if kw.get("land_sources") else {}
    sc = spark.sparkContext

    def one(name: str, build: Callable[[], DataFrame]) -> tuple[str, float, int]:
        t = time.perf_counter()
        group = f"cartlift-{name}-{id(r)}"
        sc.setJobGroup(group, name)
        sc.setLocalProperty("spark.scheduler.pool", name)
        df = build()
        if name in ("customer_features", "cohort_retention", "uplift_scores"):
            df.write.format("noop").mode("overwrite").save()
        else:
            df.collect()
        return name, time.perf_counter() - t, len(sc.statusTracker().getJobIdsForGroup(group))

    outputs = r.outputs()
    results = [one("customer_features", outputs.pop("customer_features"))]
    if parallel > 1:
        # the learners are the longest chain: start them first
        order = sorted(outputs, key=lambda k: k not in ("uplift_scores",))
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            futs = [pool.submit(one, k, outputs[k]) for k in order]
            results += [f.result() for f in futs]
    else:
        results += [one(k, b) for k, b in outputs.items()]
    for name, secs, n_jobs in results:
        times[name] = secs
        if jobs is not None:
            jobs[name] = n_jobs
    return times
