import hashlib

import pytest
from edge_tables import ROWS, edge_docs, empty_docs, rows_of, with_clashes
from pyspark.sql import functions as F

from cartlift.llm.common import ASCII_FOLD
from cartlift.llm.exact_dedup import exact_dedup, keep_first_copies

COLS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def sha(text):
    return hashlib.sha256((text or "").translate(ASCII_FOLD).encode()).hexdigest()


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_edges(spark, keep):
    out = exact_dedup(edge_docs(spark), keep=keep).collect()
    assert len(out) == len(ROWS)
    groups = {}
    for r in ROWS:
        groups.setdefault(sha(r[1]), []).append(r[0])
    for r in out:
        ids = [i for i in groups[r["text_sha256"]] if i is not None]
        assert r["group_size"] == len(groups[r["text_sha256"]])
        assert r["keep_id"] == (None if not ids else min(ids) if keep == "smallest" else max(ids))
    for digest in groups:  # exactly one row of each group stays, of repeated rows too
        assert sum(r["kept"] for r in out if r["text_sha256"] == digest) == 1


def test_only_ascii_letters_fold(spark):
    out = {r["doc_id"]: r for r in exact_dedup(edge_docs(spark)).collect()}
    assert out[1]["text_sha256"] == out[2]["text_sha256"]
    assert out[6]["text_sha256"] != out[7]["text_sha256"]  # É stays É
    assert out[3]["text_sha256"] == out[4]["text_sha256"]  # null counts as empty


def test_empty_and_clashes(spark):
    assert exact_dedup(empty_docs(spark)).count() == 0
    assert keep_first_copies(empty_docs(spark)).count() == 0
    docs = edge_docs(spark)
    assert rows_of(exact_dedup(with_clashes(docs)), *COLS) == rows_of(exact_dedup(docs), *COLS)
    kept = keep_first_copies(with_clashes(docs), keep="largest")
    assert kept.columns == with_clashes(docs).columns
    assert kept.count() == len({sha(r[1]) for r in ROWS})


def test_many_runs_and_small_arity(spark):
    docs = spark.range(0, 3000, numPartitions=40).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
            (F.col("id") % 700).cast("string")).alias("text"))
    a = rows_of(exact_dedup(docs, arity=2), *COLS)
    assert a == rows_of(exact_dedup(docs, arity=16), *COLS)
    hot = [r for r in a if r[4] == sha("hot")]
    assert len(hot) == 1000 and {r[1] for r in hot} == {0} and {r[2] for r in hot} == {1000}


def test_native_plan(spark):
    plan = exact_dedup(edge_docs(spark))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
