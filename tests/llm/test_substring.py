from collections import Counter

import numpy as np
import pytest
from edge_tables import ROWS, documents, edge_docs, empty_docs, rows_of, with_clashes

from cartlift.llm import substring as S
from conftest import SF001


def brute(rows, k):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[p:p + k]) for w in words for p in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - k + 1):
            if seen[tuple(w[p:p + k])] > 1:
                gone[p:p + k] = True
        out.append((d, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=repr)


COLS = ["doc_id", "n_words", "n_removed", "kept_text"]


@pytest.mark.parametrize("window", [3, 9, 35])
def test_edges(spark, window):
    rows = [r for r in ROWS if r[0] not in (8, 9)] + [(8, "a b " * 200), (9, "a a a a a a a"), (20, "a a a a a a b")]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(3)
    assert rows_of(S.substring_dedup(docs, window=window), *COLS) == brute([(r[0], r[1]) for r in rows], window)


def test_long_copies_and_clashes(spark):
    docs = edge_docs(spark)
    got = rows_of(S.substring_dedup(docs, window=35), *COLS)
    assert got == brute([(r[0], r[1]) for r in ROWS], 35)
    assert rows_of(S.substring_dedup(with_clashes(docs), window=35), *COLS) == got
    assert S.substring_dedup(empty_docs(spark)).count() == 0


def test_matches_brute_force_over_many_bundles(spark, monkeypatch):
    monkeypatch.setattr(S, "BUNDLE_CHARS", 20_000)
    d = documents(SF001)
    got = S.substring_dedup(spark.read.parquet(f"{SF001}/documents.parquet"), window=35)
    assert rows_of(got, *COLS) == brute(list(zip(d.doc_id.tolist(), d.text)), 35)


def test_spans_are_the_removed_words(spark):
    got = {r["doc_id"]: r for r in S.substring_dedup(edge_docs(spark), window=35).collect()}
    assert [(s["start"], s["end"]) for s in got[11]["spans"]] == [(2, 63)]  # "right" follows in both
    assert got[11]["kept_text"] == "left one one"


def test_sequence_hashes_tell_sequences_apart():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 2 ** 63, 5, dtype=np.uint64)[rng.integers(0, 5, 3000)]
    own = S.Sequences(words, S.BASE1).of(4)
    groups = {}
    for i, h in enumerate(own.tolist()):
        groups.setdefault(h, set()).add(tuple(words[i:i + 4].tolist()))
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({tuple(words[i:i + 4].tolist()) for i in range(2997)})
    x = rng.integers(0, 99, 50)
    assert (S.sliding_min(x, 28) == [x[i:i + 28].min() for i in range(23)]).all()
