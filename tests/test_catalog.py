"""Every registered query against its DuckDB oracle on the smallest tables,
the entry smoke check, and the planted truth at sf0.1."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from oracle_harness import compare

from cartlift.plans.catalog import QUERIES
from cartlift.plans.oracle import ORACLES

SLOW = {"uplift_scores", "model_policy_readout", "learner_evaluation"}


@pytest.fixture(scope="module", autouse=True)
def shared_tables():
    from cartlift.plans.catalog import shared_contexts
    with shared_contexts():
        yield


def test_every_query_registered_with_docs():
    assert set(ORACLES) <= set(QUERIES) <= set(E.queries())
    assert len(QUERIES) >= 50


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle_sf0001(spark, name):
    ok, msg = compare(QUERIES[name](spark, SF001), ORACLES[name], SF001)
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF001).count() >= 1


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["decision"] in ("LAUNCH", "HOLD")
    assert len(df.columns) == 19


def test_planted_uplift_is_ranked(spark):
    """FIXTURES.md: treated customers with >= 10 pre-campaign orders get the
    larger planted lift, so the T-learner's top-scored customers must hold
    more of them and show more lift than its bottom ones."""
    from cartlift.plans.context import Context
    c = Context(spark, "/root/testdata/sf0.1")
    scored = c.scored_model.join(c.features.select("client_id", "n_tx"), "client_id")
    dec = (scored.transform(lambda d: __import__("cartlift.operators.curves", fromlist=["x"])
                            .with_deciles(d, "t_score"))
           .groupBy("decile").agg(F.avg((F.col("n_tx") >= 10).cast("double")).alias("heavy"),
                                 (F.avg(F.when(F.col("treatment_flg") == 1, F.col("target")))
                                  - F.avg(F.when(F.col("treatment_flg") == 0, F.col("target")))).alias("up"))
           .toPandas().set_index("decile").sort_index())
    assert dec.heavy.iloc[-3:].mean() > dec.heavy.iloc[:3].mean()
    assert dec.up.iloc[-3:].mean() > dec.up.iloc[:3].mean()


def test_registered_learners_do_the_default_work(spark):
    """Queries, bench and scale bench boost as long as the original analysis."""
    from cartlift.config import AnalysisConfig
    from cartlift.plans.context import Context
    own, full = Context(spark, SF001).config, AnalysisConfig()
    assert (own.learner, own.learner_iters, own.learner_step) == (full.learner, 500, 0.05)
    assert AnalysisConfig.fixture() == own and (full.learner_iters, full.learner_step) == (500, 0.05)
