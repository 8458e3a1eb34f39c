"""Toxicity classifier with counterfactual regularisation.

A logistic scorer over the words of a text and their prefixes (hashed; present,
or shared by several distinct words) is fitted with the penalty

    strength * mean over swaps (f(x) - f(x'))^2

where x' is a labelled sentence x with an identity term replaced by another
one.  Sentences that mention a group are swapped as they stand; in others one
word gives its place to two different terms, so that each term's weight is
held to that of the others even where the corpus seldom names it.  A neutral
mention of a group therefore can't raise the score.

Fitting takes a bounded sample of labelled rows (``max_toxic`` and
``max_other``, lowest id hash); scoring reads whole texts of all rows.

Defined cases: null and empty texts score as the intercept alone; without both
classes in the sample every score is the share of toxic rows; repeated ids
are scored row by row; other columns pass through unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlift.llm.common import replacing, row_chunks
from cartlift.llm.linear import adam, hash_sample, sigmoid

SPACE = 1 << 30
PREFIXES = (4, 5, 6, 7)
#: A feature that this many distinct words of a text share is a further feature, under the masked hash.
LEVELS = ((2, 0x15555555), (4, 0x2AAAAAAA))
#: Neutral group mentions that are swapped for one another (a parameter of ``fit``).
IDENTITY_TERMS = ("women", "men", "girls", "boys", "muslims", "christians", "jews", "hindus", "gay", "lesbian",
                  "transgender", "straight", "black", "white", "asian", "african", "latino", "immigrants",
                  "refugees", "elderly", "disabled", "deaf", "blind", "teenagers")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


class Hashes(dict):
    """word -> hashed features of the word itself and of its prefixes."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 300_000:
            self.clear()
        parts = {"w" + word} | {f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n}
        h = self[word] = tuple(xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) % SPACE for p in sorted(parts))
        return h


def text_features(text: str | None, hashes: Hashes) -> set[int]:
    seen: Counter = Counter()
    for w in set(_WORD.findall(text.lower())) if text else ():
        seen.update(hashes[w])
    return set(seen).union(*({h ^ mask for h, n in seen.items() if n >= least} for least, mask in LEVELS))


def counterfactual(text: str, terms: tuple[str, ...], hashes: Hashes) -> tuple[list[int], list[int]]:
    """Features that only the sentence and only its swapped version have."""
    sentences = [s for s in _SENTENCE.findall(text.lower()) if _WORD.search(s)]
    if not sentences or len(terms) < 2:
        return [], []
    seed = xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))
    held = [s for s in sentences if any(w in terms for w in _WORD.findall(s))]
    words = _WORD.findall(held[seed % len(held)] if held else sentences[seed % len(sentences)])
    places = [i for i, w in enumerate(words) if w in terms] or [seed % len(words)]
    at = places[seed // 7 % len(places)]
    own = words[at] if words[at] in terms else terms[seed // 11 % len(terms)]
    other = terms[(terms.index(own) + 1 + seed // 13 % (len(terms) - 1)) % len(terms)]
    rest = set().union(*(hashes[w] for i, w in enumerate(words) if i != at), set())
    a, b = set(hashes[own]) - rest, set(hashes[other]) - rest
    return sorted(a - b), sorted(b - a)


@dataclass
class ToxicityModel:
    index: np.ndarray    # sorted feature hashes
    weights: np.ndarray  # weight of each
    bias: float

    def table(self) -> dict[int, float]:
        return dict(zip(self.index.tolist(), self.weights.tolist()))


def sample_rows(rows: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """Features and counterfactual differences of (toxic, text) rows."""
    def run(batches):
        hashes = Hashes()
        for part in row_chunks(batches, ["toxic", "text"]):
            feats = [np.array(sorted(text_features(t, hashes)), dtype=np.int32).tobytes() for _, t in part]
            swaps = [counterfactual(t or "", terms, hashes) for _, t in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array([y for y, _ in part], pa.int32()), pa.array(feats, pa.binary()),
                 pa.array([s[0] for s in swaps], pa.list_(pa.int64())),
                 pa.array([s[1] for s in swaps], pa.list_(pa.int64()))], names=["toxic", "x", "plus", "minus"])

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, x binary, plus array<long>, minus array<long>")


def regularised_fit(y: np.ndarray, feats: list[np.ndarray], swaps: list[tuple[list[int], list[int]]], share: float,
                    strength: float = 10.0, ridge: float = 2e-4, max_features: int = 8_000, min_docs: int = 3,
                    steps: int = 500, rate: float = 0.05) -> ToxicityModel:
    """Logistic fit with the squared score change over the swaps as penalty.

    ``share`` is the toxic share of all labelled rows; the sample's classes are
    weighted back to it.  Of the hashed features the ``max_features`` with the
    largest signed chi-square stay, and all features of identity terms.
    """
    start = float(np.log(share / (1 - share)))
    n_pos, n_neg = int((y == 1).sum()), int((y == 0).sum())
    if not n_pos or not n_neg:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), start)
    flat = np.concatenate(feats)
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(f) for f in feats])
    ids, inv = np.unique(flat, return_inverse=True)
    df1 = np.bincount(inv[y[row] == 1], minlength=len(ids))
    df0 = np.bincount(inv, minlength=len(ids)) - df1
    del inv
    expect = (df1 + df0) * n_pos / len(y)
    chi = (df1 - expect) ** 2 / np.maximum(expect, 1e-9)
    chi[df1 + df0 < min_docs] = -1
    keep = np.zeros(len(ids), bool)
    keep[np.argsort(-chi, kind="stable")[:max_features]] = True
    keep &= chi > 0
    named = Counter(i for s in swaps for side in s for i in side)
    index = np.union1d(ids[keep].astype(np.int64), np.array(sorted(named), dtype=np.int64))
    pos = np.searchsorted(index, flat)
    ok = (pos < len(index)) & (index[np.minimum(pos, len(index) - 1)] == flat)
    col, row = pos[ok], row[ok]
    s_row = np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b in swaps])
    s_col = np.searchsorted(index, np.array([i for a, b in swaps for i in (*a, *b)], dtype=np.int64))
    s_val = np.array([v for a, b in swaps for v in (*[1.0] * len(a), *[-1.0] * len(b))])
    weight = np.where(y == 1, share / n_pos, (1 - share) / n_neg)

    def grad(w):
        z = np.bincount(row, weights=w[col], minlength=len(y)) + w[-1]
        r = weight * (sigmoid(z) - y)
        g = np.bincount(col, weights=r[row], minlength=len(index))
        if len(s_col):
            change = np.bincount(s_row, weights=w[s_col] * s_val, minlength=len(swaps))
            g = g + 2 * strength / len(swaps) * np.bincount(s_col, weights=change[s_row] * s_val, minlength=len(index))
        return np.concatenate([g + ridge * w[:-1], [r.sum()]])

    w = adam(grad, np.concatenate([np.zeros(len(index)), [start]]), steps, rate)
    return ToxicityModel(index, w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
        terms: tuple[str, ...] = IDENTITY_TERMS, max_toxic: int = 1500, max_other: int = 3000) -> ToxicityModel:
    """Fit on rows of ``docs`` and ``labels`` that may be learnt from."""
    known = labels.where(F.col(label_col).isin(0, 1))
    share = known.agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    share = float(min(0.99, max(0.001, 0.5 if share is None else share)))
    picks = (hash_sample(known.where(F.col(label_col) == 1), id_col, max_toxic).withColumn("toxic", F.lit(1))
             .unionByName(hash_sample(known.where(F.col(label_col) == 0), id_col, max_other).withColumn("toxic", F.lit(0))))
    # at most max_toxic + max_other ids: the broadcast is bounded
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picks), "id")
    got = sample_rows(rows, tuple(terms)).collect()
    got.sort(key=lambda r: (r["toxic"], bytes(r["x"])))  # the fit doesn't depend on the order of arrival
    return regularised_fit(np.array([r["toxic"] for r in got]), [np.frombuffer(r["x"], np.int32) for r in got],
                           [(r["plus"], r["minus"]) for r in got], share)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns, with the score (P of toxic) appended.  The model
    (at most ``max_features`` weights) travels with the task.  A column named
    like the score is replaced."""
    docs = replacing(docs, score_col)

    class Weights(dict):
        """word -> its features that have a weight"""

        def __init__(self, table):
            super().__init__()
            self.table, self.hashes = table, Hashes()

        def __missing__(self, word):
            if len(self) >= 300_000:
                self.clear()
            v = self[word] = tuple(h for h in self.hashes[word]
                                   if h in self.table or any(h ^ mask in self.table for _, mask in LEVELS))
            return v

    def run(batches):
        table = model.table()
        known = Weights(table)
        for b in batches:
            z = []
            for (text,) in (r for rows in row_chunks([b], [text_col]) for r in rows):
                seen: Counter = Counter()
                for w in set(_WORD.findall(text.lower())) if text else ():
                    seen.update(known[w])
                z.append(model.bias + sum(table.get(h, 0.0) + sum(table.get(h ^ mask, 0.0) for least, mask in LEVELS
                                                                  if n >= least) for h, n in seen.items()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigmoid(np.array(z, dtype=float)), pa.float64())],
                                             names=[*b.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
