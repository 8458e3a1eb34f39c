"""Per-query context: fixture tables and the shared customer table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from cartlift.config import AnalysisConfig
from cartlift.session import materialize
from cartlift.sources.fixtures import fixture_clients, fixture_purchases, fixture_train, line_parts

GENDER_CATEGORIES = ("F", "M", "U")


class Context:
    def __init__(self, spark: SparkSession, sf_dir: str, config: AnalysisConfig | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.config = config or AnalysisConfig.fixture()

    @cached_property
    def purchases(self) -> DataFrame:
        return fixture_purchases(self.spark, self.sf_dir)

    @cached_property
    def line_parts(self) -> int | None:
        return line_parts(self.spark, self.sf_dir)

    @cached_property
    def clients(self) -> DataFrame:
        return fixture_clients(self.spark, self.sf_dir)

    @cached_property
    def train(self) -> DataFrame:
        return fixture_train(self.spark, self.sf_dir)

    def features_lazy(self) -> DataFrame:
        from cartlift.operators.features import customer_features
        return customer_features(self.train, self.clients, self.purchases,
                                 gender_cats=GENDER_CATEGORIES, parts=self.line_parts)

    @cached_property
    def features(self) -> DataFrame:
        """Customer table, checkpointed: read by many later jobs."""
        return materialize(self.features_lazy())

    @property
    def features_once(self) -> DataFrame:
        """The customer table for a single aggregate: read as it is if it was
        written already, else left lazy, so that only the needed columns are built."""
        return self.__dict__.get("features") or self.features_lazy()

    @cached_property
    def segmented(self) -> DataFrame:
        from cartlift.operators.product import attach_segments
        return materialize(attach_segments(self.features, rank_kw=self.config.rank_kw))

    @cached_property
    def scored_fixed(self) -> DataFrame:
        """Test split scored by a fixed heuristic (purchase count) instead of a
        model, so curves, deciles, policy and monitoring have an exact oracle."""
        from pyspark.sql import functions as F
        from cartlift.operators.uplift import train_test_split
        s = train_test_split(self.segmented, self.config.test_share, self.config.split_salt)
        s = s.where(F.col("split") == "test").select(
            "client_id", "treatment_flg", "target", "rfm_segment",
            F.coalesce(F.col("n_tx"), F.lit(0)).cast("double").alias("score"))
        return materialize(s)

    @cached_property
    def scored_model(self) -> DataFrame:
        """All customers with cross-fitted scores (T: the pre-specified primary score)."""
        from cartlift.operators.features import feature_names
        from cartlift.operators.uplift import uplift_scores
        s = self.segmented
        return materialize(uplift_scores(s, feature_names(s), self.config))

    @cached_property
    def scored_holdout(self) -> DataFrame:
        """The test split alone, scored by models of the train split."""
        from cartlift.operators.features import feature_names
        from cartlift.operators.uplift import holdout_scores
        s = self.segmented
        return materialize(holdout_scores(s, feature_names(s), self.config))
