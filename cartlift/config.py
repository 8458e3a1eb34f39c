"""Analysis parameters (defaults follow the original analysis)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class AnalysisConfig:
    window_days: int = 7            # pre-period window = outcome window
    mde: float = 0.01               # minimum detectable effect (fraction)
    alpha: float = 0.05
    power: float = 0.80
    ci_z: float = 1.96              # fixed z for the naive and segment CIs
    srm_ratio: float = 0.5          # expected treated share
    srm_alpha: float = 0.001
    smd_threshold: float = 0.1
    practical_mde: float = 0.01
    champ_incr_max: float = 0.35
    test_share: float = 0.3
    split_salt: str = "split"
    k_percent: float = 0.30
    epsilon: float = 0.05
    cycle: str = "0"
    psi_bins: int = 10
    period_salt: str = "period"
    learner: str = "committee"      # committee (trees fitted in tasks) | gbt | rf | logistic (spark.ml, all rows)
    learner_iters: int = 500        # boosting rounds and step of the original analysis
    learner_step: float = 0.05
    learner_depth: int = 3
    learner_min_leaf: int = 30
    learner_subset: str = "0.8"
    learner_l2: float = 1.0
    learner_folds: int = 5          # cross-fitting folds; 1 scores the test split alone
    fold_salt: str = "fold"
    member_rows: int = 65_536       # committee: rows of a member, and most members of a model; a model of more
    members: int = 16               # rows than their product deals them all to that many, larger, members
    seed: int = 42
    sample_frac: float | None = None        # keep this share of the experiment customers
    sample_salt: str = "sample"
    null_future_dates: bool = False         # blank card dates after the reference time (leak-safe)
    approximate_breadth: bool = False       # sketches instead of exact distinct counts
    approximate_medians: bool = False       # sketches instead of exact medians in the regression
    approximate_cutoffs: bool = False       # quantile sketches instead of exact top-k% cutoffs
    key_features: tuple[str, ...] = ("recency_days", "n_tx", "spend_total")  # watched for drift besides the score
    unit_value: float = 1.0                 # money view of the policy: value of a response, cost of a send
    unit_cost: float = 0.01
    events_reference_end: str | None = None  # event time before which the stream's reference slice lies
    rank_kw: dict = field(default_factory=dict)

    @classmethod
    def fixture(cls) -> "AnalysisConfig":
        """The test fixtures measure the outcome over 180 days (FIXTURES.md);
        their first week of events is the reference slice.  Learners do the
        default work."""
        return cls(window_days=180, events_reference_end="2024-01-08")

    def with_(self, **kw) -> "AnalysisConfig":
        return replace(self, **kw)
