import sys
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest
from edge_tables import ROWS, edge_docs, empty_docs, with_clashes
from pyspark.sql import functions as F

from cartlift.llm import langid, quality, toxicity
from cartlift.llm.queries import QUERIES

SF1 = "/root/testdata/sf0.1"


def held_out(spark, name, truth):
    got = QUERIES[name](spark, SF1).toPandas()
    docs = pd.read_parquet(f"{SF1}/documents.parquet")
    assert len(got) == len(docs)
    return got.merge(truth(docs), on="doc_id")


def labels(column):
    return lambda docs: pd.read_parquet(f"{SF1}/labels.parquet")[["doc_id", column]].rename(columns={column: "y"})


def test_quality_held_out(spark):
    d = held_out(spark, "op5_quality", labels("quality"))
    d = d[d.held_out]
    assert len(d) > 1000 and (d.predicted == d.y).mean() > 0.97
    assert d.score.between(0, 1).all() and d[d.y == 1].score.mean() > 0.9 > 0.2 > d[d.y == 0].score.mean()


def test_toxicity_held_out(spark):
    d = held_out(spark, "op6_toxicity", labels("toxic"))
    d = d[d.held_out]
    assert len(d) > 800 and d[d.y == 1].predicted.mean() > 0.8 and d[d.y == 0].predicted.mean() < 0.02
    assert ((d.score >= 0.3).astype(int) == d.predicted).all()


def test_language_held_out(spark):
    d = held_out(spark, "op7_language_id", lambda docs: docs[["doc_id", "lang"]].rename(columns={"lang": "y"}))
    d = d[d.held_out]
    assert len(d) > 2000 and (d.lang_pred == d.y).mean() > 0.99 and d.score.between(0, 1).all()


def test_suffix_automaton_accepts_exactly_the_substrings():
    text = [1, 2, 1, 2, 3, 1, 1, 2, 3, 3, 1]
    table = langid.suffix_automaton(text, 5)

    def accepts(s):
        state = 0
        for c in s:
            state = table[state, c]
            if state < 0:
                return False
        return True
    rng = np.random.default_rng(0)
    for _ in range(3000):
        s = rng.integers(1, 4, rng.integers(1, 7)).tolist()
        assert accepts(s) == any(text[i:i + len(s)] == s for i in range(len(text)))


def test_phrases_are_greedy_longest_matches():
    m = langid.Automaton.of(b"abcab")
    lanes = m.code[np.frombuffer(b"abccbca\0", np.uint8)][:, None]  # abc | c | bca
    assert langid.phrase_counts(lanes, m.table, m.pad).tolist() == [3]


def plain_phrases(text, sample):
    """Greedy longest matches, by looking pieces up in the sample itself."""
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i:i + n + 1] in sample:
            n += 1
        i += n
        count += 1
    return count


def test_predictions_against_plain_parsing(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), chars_per_lang=2000)
    assert len(model.tables) > 1
    samples = {l: bytes(walk(m)) for l, m in model.tables.items()}
    texts = [t[:langid.LANE // 4] for t in docs.text.dropna()[:60]] + ["²", "", None, "7 - 8"]
    for text, (lang, score, letter) in zip(texts, langid.classify(texts, model)):
        if not text or not any(c.isalpha() for c in text):
            assert (lang, score, letter) == ("und", 0.0, False)
            continue
        cost = sorted((plain_phrases(langid.symbols_of(text), s) * np.log2(len(s) + 1), l) for l, s in samples.items())
        assert lang == cost[0][1] and score == pytest.approx(cost[1][0] / (cost[0][0] + cost[1][0]))


def walk(m):
    """The sample, read off its automaton: the one path that visits ``symbols`` states in order of length."""
    value = {int(c): b for b, c in enumerate(m.code.tolist()) if b and c < m.pad - 1}
    sys.setrecursionlimit(20_000)

    @lru_cache(None)
    def longest(state):
        steps = [(1 + longest(int(t))[0], c) for c, t in enumerate(m.table[state]) if t >= 0]
        return max(steps) if steps else (0, -1)
    state, out = 0, []
    while longest(state)[0]:
        c = longest(state)[1]
        out.append(value[c])
        state = int(m.table[state][c])
    assert len(out) == m.symbols
    return out


def test_language_edges(spark):
    docs = edge_docs(spark)
    model = langid.fit(docs)
    assert set(model.tables) == {"en", "fr", "la"}
    got = langid.identify(with_clashes(docs), model, score_col="lang_score").collect()
    assert len(got) == len(ROWS)
    for r in got:
        none = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == none and 0 <= r["lang_score"] <= 1
    assert {r["doc_id"]: r["lang_pred"] for r in got}[9] == "la"
    nothing = langid.fit(empty_docs(spark))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty_docs(spark), model).count() == 0


def test_long_text_is_read_whole():
    model = langid.LanguageModel({"x": langid.Automaton.of(b"a" * 50), "y": langid.Automaton.of(b"b" * 50)})
    assert langid.classify(["a" * 1000 + "b" * 9000, "a" * 9000 + "b" * 1000], model)[0][0] == "y"
    assert langid.classify(["a" * 1000 + "b" * 9000, "a" * 9000 + "b" * 1000], model)[1][0] == "x"


def test_sample_comes_from_all_of_a_text_and_all_documents(spark):
    docs = spark.createDataFrame([(1, "x", "a" * 60_000 + "q" * 60_000), (2, "x", "zz " * 40), (3, "y", "b" * 500)],
                                 "doc_id long, lang string, text string")
    model = langid.fit(docs)
    lacks = {l: m.pad - 1 for l, m in model.tables.items()}
    for lang, letters in {"x": b"aqz", "y": b"b"}.items():
        assert all(model.tables[lang].code[c] < lacks[lang] for c in letters)
    assert langid.classify(["bbbb"], langid.LanguageModel({"y": model.tables["y"]}))[0][1] > 0.4


def test_appended_columns_replace_those_of_the_same_name(spark):
    docs = with_clashes(edge_docs(spark)).withColumn("SCORE", F.lit("old")).withColumn("lang_pred", F.lit("old"))
    known = spark.createDataFrame([(1, 1, 1), (6, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    for got in (langid.identify(docs, langid.fit(docs)), quality.score(docs, quality.fit(docs, known)),
                toxicity.score(docs, toxicity.fit(docs, known))):
        assert [c.lower() for c in got.columns].count("score") == 1 and got.schema["score"].dataType.typeName() == "double"
        assert got.count() == len(ROWS)


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_prior_is_estimated_without_negative_labels(prior):
    rng = np.random.default_rng(4)
    n = int(3000 * prior)
    pos = rng.normal(0.4, 0.5, (1500, quality.WIDTH))
    unl = np.concatenate([rng.normal(0.4, 0.5, (n, quality.WIDTH)), rng.normal(-0.4, 0.5, (3000 - n, quality.WIDTH))])
    assert abs(quality.estimate_prior(pos, rng.permutation(unl)) - prior) < 0.06


def test_non_negative_risk_separates_unlabelled_mixture():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1, 0.5, (600, quality.WIDTH)), rng.normal(-1, 0.5, (300, quality.WIDTH))
    unl = np.concatenate([good[300:], bad[:150]])
    m = quality.nn_pu_fit(good[:300], unl, prior=300 / 450)
    assert (m.score(good[300:]) > 0.5).mean() > 0.95 and (m.score(bad[150:]) < 0.5).mean() > 0.95


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scorer_edges(spark, module):
    docs = with_clashes(edge_docs(spark))
    column = "quality" if module is quality else "toxic"
    known = spark.createDataFrame([(1, 1), (6, 0), (8, 1), (8, 1), (13, 0), (14, 0), (None, 1), (2, None), (77, 1)],
                                  f"doc_id long, {column} int")
    for labels_ in (known, known.where("doc_id < 0"), known.where(f"{column} = 1")):
        model = module.fit(docs, labels_)
        got = module.score(docs, model, score_col="p").collect()
        assert len(got) == len(ROWS) and all(0 <= r["p"] <= 1 for r in got)
        assert len({r["p"] for r in got if not r["text"]}) == 1
    assert module.score(empty_docs(spark), model).count() == 0
    assert module.score(empty_docs(spark), module.fit(empty_docs(spark), known)).count() == 0


def test_counterfactual_penalty_evens_out_group_mentions():
    """One group is named in toxic sentences only; its neutral mention must not count."""
    rng = np.random.default_rng(0)
    terms, hashes = ("alphas", "betas", "gammas"), toxicity.Hashes()
    rows = []
    for i in range(400):
        filler = " ".join(f"word{rng.integers(0, 60)}" for _ in range(8))
        toxic = i % 4 == 0
        group = "alphas" if toxic else terms[1 + i % 2]
        rows.append((int(toxic), f"{filler} {group}" + (" nastyword" if toxic and i % 8 == 0 else "")))
    y = np.array([r[0] for r in rows])
    feats = [np.array(sorted(toxicity.text_features(t, hashes)), np.int32) for _, t in rows]
    swaps = [toxicity.counterfactual(t, terms, hashes) for _, t in rows]

    def gap(strength):
        table = toxicity.regularised_fit(y, feats, swaps, 0.25, strength=strength).table()

        def z(t):
            return sum(table.get(f, 0.0) for f in toxicity.text_features(t, hashes))
        return z("neutral words about alphas") - z("neutral words about betas")
    assert gap(0.0) > 2 and gap(50.0) < 0.2 * gap(0.0)
