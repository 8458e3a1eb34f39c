from edge_tables import SCHEMA, edge_docs, empty_docs, with_clashes
from test_near_dup import brute as near_brute
from test_packing import check_packing
from test_secrets import base_spans

import __spark_entry__ as E
import corpus_pipeline as P
from cartlift.llm.common import ASCII_FOLD
from conftest import SF001


def test_stages_follow_each_other(spark):
    """Every stage against brute force on what the one before it kept."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = P.materialize(stage(spark, docs, SF001), name)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns and len(after) == docs.count()
        if name == "language":
            assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r["text"] or "")}
        elif name == "exact_dedup":
            by_text = {}
            for i, r in before.items():
                by_text.setdefault((r["text"] or "").translate(ASCII_FOLD), []).append(i)
            assert set(after) == {max(ids) for ids in by_text.values()}
        elif name == "near_dedup":
            assert set(after) == {i for i, _, c in near_brute([(i, r["text"]) for i, r in before.items()], 5) if i == c}
        else:
            assert set(after) == set(before)
            for i, r in after.items():
                if base_spans(before[i]["text"]):
                    assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
                else:
                    assert r == before[i]
        if name != "secrets":
            assert all(after[i]["text"] == before[i]["text"] for i in after)
    pieces = P.STAGES[-1][1](spark, docs, SF001).collect()
    check_packing(pieces, [(r["doc_id"], r["text"]) for r in docs.collect()])
    whole = E.queries()["pipeline"](spark, SF001)
    assert whole.count() == len(pieces) and whole.select("doc_id").distinct().count() == docs.count()


def test_edges(spark):
    docs = edge_docs(spark)
    for name, stage in P.STAGES:
        assert stage(spark, empty_docs(spark), SF001).count() == 0
        out = stage(spark, with_clashes(docs), SF001)
        if name == "packing":
            assert out.count() >= docs.count()
        else:
            assert out.columns == with_clashes(docs).columns
            docs = P.materialize(out, name).select(*docs.columns)
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == {2, 6, 7, 8, 11, 13, 14, 15, None}  # 12 repeats 11, 9 repeats 8


def test_language_stage_rejects_by_letters_only(spark):
    """Neither a corpus without labels nor the label ``und`` loses a text with a letter."""
    rows = [(1, "one plain text", "a"), (2, "another text", "b"), (3, None, "a"), (4, "12 !?", "b"), (5, "été", "a")]

    def kept(langs):
        docs = spark.createDataFrame([(i, t, langs.get(i), s, 1) for i, t, s in rows], SCHEMA)
        return {r["doc_id"]: r["lang"] for r in P.language_stage(spark, docs, SF001).collect()}
    assert kept({}) == {1: None, 2: None, 5: None}
    assert kept({1: "und"}) == {1: "und", 2: "und", 5: "und"}
    assert kept({1: "en", 2: "und"}).keys() == {1, 2, 5}


def test_near_stage_tells_rows_under_one_id_apart(spark):
    """Near copies under a repeated or null id leave one document of a group."""
    def text(word, last):
        return " ".join(f"{word}{i}" for i in range(60)) + f" {last}"
    rows = [(1, text("a", "x")), (1, text("a", "y")), (2, text("a", "z")), (4, text("b", "x")), (1, text("b", "y")),
            (3, text("c", "x")), (3, text("a", "w")), (None, text("d", "x")), (None, text("d", "y")),
            (None, text("b", "z")), (None, "lone text"), (9, "another")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    got = P.near_stage(spark, docs, SF001).collect()
    assert sorted((r["text"][0], r["doc_id"] or 0) for r in got) == [
        ("a", 1), ("a", 9), ("b", 1), ("c", 3), ("d", 0), ("l", 0)]
