"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text are enough: with the class prior p, the
risk of a scorer f over all text is

    p E_pos[l(f)]  +  max(0, E_unl[l(-f)] - p E_pos[l(-f)])

(the non-negative unbiased risk).  The second term is the risk on the unseen
negatives; where it turns negative on the sample, its gradient is reversed, so
the scorer can't overfit the positives.  f is linear in text statistics and in
hashed word shapes; the loss is logistic, so sigmoid(f) estimates P(good).

The class prior, too, comes from positives and unlabelled rows alone.

Fitting takes bounded samples (``max_positives`` and ``max_unlabelled`` rows
of lowest id hash); scoring reads whole texts of all rows.

Defined cases: a null or empty text has all features 0 and still gets a score;
without positives or unlabelled rows every score is the prior (0.5 where none is given); rows with null
ids are scored; other columns pass through unchanged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlift.llm.common import replacing, row_chunks
from cartlift.llm.linear import adam, hash_sample, sigmoid, softplus

SHAPES = 256
STATS = 14
WIDTH = STATS + SHAPES
_LETTERS = re.compile(r"[^\W\d_]+")
_CLASSES: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of each code point of the basic plane: 0 other, 1 space, 2 lower
    (or caseless) letter, 3 upper-case letter, 4 digit, 5 sentence mark, 6 other mark."""
    if not _CLASSES:
        t = np.zeros(65536, dtype=np.uint8)
        for cp in range(65536):
            c = chr(cp)
            t[cp] = (1 if c.isspace() else 3 if c.isupper() else 2 if c.isalpha() else 4 if c.isdigit()
                     else 5 if c in ".,;:!?'\"-()" else 6)
        _CLASSES.append(t)
    return _CLASSES[0]


def shape(word: str) -> int:
    """Hashed shape of a word: letter runs as x, X or Xx, digit runs as 9, marks kept."""
    s = _LETTERS.sub(lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "Xx" if m[0][0].isupper() else "x", word)
    s = re.sub(r"\d+", "9", s)
    return xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass")) % SHAPES


class Shapes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = shape(word)
        return h


def features(text: str | None, shapes: Shapes) -> np.ndarray:
    """Statistics of the whole text, then root frequencies of the hashed word shapes."""
    out = np.zeros(WIDTH, dtype=np.float32)
    if not text:
        return out
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.bincount(char_classes()[np.minimum(cps, 65535)], minlength=7) / len(cps)
    words = text.split()
    n = max(1, len(words))
    lines = text.split("\n")
    again = sum(map(eq, words, words[1:])) / n
    again2 = sum(map(eq, words, words[2:])) / n
    out[:STATS] = [1.0, *kinds[1:], np.log1p(n) / 8, len(text) / n / 10, len(set(words)) / n, again,
                   again2, 1 - len(set(lines)) / len(lines), text.count("|") / n]
    if words:
        idx = np.fromiter(map(shapes.__getitem__, words), dtype=np.int64, count=len(words))
        out[STATS:] = np.sqrt(np.bincount(idx, minlength=SHAPES) / n)
    return out


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(((x - self.mean) / self.scale) @ self.weights + self.bias)


def feature_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Packed feature vector of each row (column ``x``), other columns dropped except ``part``."""
    def run(batches):
        shapes = Shapes()
        for rows in row_chunks(batches, ["part", text_col]):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()),
                 pa.array([features(r[1], shapes).tobytes() for r in rows], pa.binary())], names=["part", "x"])

    return docs.select("part", text_col).mapInArrow(run, "part string, x binary")


def nn_pu_fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 600, rate: float = 0.02,
              ridge: float = 1e-4) -> QualityModel:
    """Minimise the non-negative unbiased risk over linear scorers."""
    both = np.concatenate([pos, unl])
    if not len(pos) or not len(unl):
        return QualityModel(np.zeros(WIDTH), float(np.log(prior / (1 - prior))), np.zeros(WIDTH), np.ones(WIDTH), prior)
    mean, scale = unl.mean(0), both.std(0) + 0.02
    p, u = (pos - mean) / scale, (unl - mean) / scale

    def grad(w):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        at_pos = -prior * sigmoid(-zp) / len(zp)                    # gradient of p E_pos[l(f)]
        at_unl = sigmoid(zu) / len(zu)                              # of E_unl[l(-f)]
        minus = -prior * sigmoid(zp) / len(zp)                      # of -p E_pos[l(-f)]
        negative_risk = softplus(zu).mean() - prior * softplus(zp).mean()
        if negative_risk >= 0:
            gp, gu = at_pos + minus, at_unl
        else:                                                       # undo the overfit first
            gp, gu = -minus, -at_unl
        return np.concatenate([p.T @ gp + u.T @ gu + ridge * w[:-1], [gp.sum() + gu.sum()]])

    w = adam(grad, np.zeros(WIDTH + 1), steps, rate)
    return QualityModel(w[:-1], float(w[-1]), mean, scale, prior)


def estimate_prior(pos: np.ndarray, unl: np.ndarray, sure: float = 0.1) -> float:
    """Share of positives among unlabelled text, from feature rows of both.

    A scorer is fitted on half of the rows to tell positives from unlabelled
    ones.  On the other half, the part of the unlabelled rows scored above a
    threshold, over that part of the positives, is an upper bound of the share;
    its lower envelope over all thresholds, with a margin for what small counts
    leave open (probability ``sure``), is the estimate, kept off 0 and 1."""
    if min(len(pos), len(unl)) < 4:
        return 0.5
    model = nn_pu_fit(pos[::2], unl[::2], 0.5)
    p, u = np.sort(model.score(pos[1::2])), np.sort(model.score(unl[1::2]))
    at = p[: max(1, int(0.95 * len(p)))]                       # thresholds that some positives pass
    above_p = 1 - np.searchsorted(p, at, side="left") / len(p)
    above_u = 1 - np.searchsorted(u, at, side="left") / len(u)
    margin = np.sqrt(np.log(4 / sure) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    best = int(np.argmin((above_u + margin) / above_p))
    return float(min(0.99, max(0.01, above_u[best] / above_p[best])))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
        label_col: str = "quality", prior: float | None = None, max_positives: int = 6000,
        max_unlabelled: int = 10_000) -> QualityModel:
    """Fit on rows of ``docs`` and ``labels`` that may be learnt from; of the
    labels only the positive ones are used."""
    known = labels.where(F.col(label_col) == 1)
    picks = (hash_sample(known, id_col, max_positives).withColumn("part", F.lit("pos"))
             .unionByName(hash_sample(docs, id_col, max_unlabelled).withColumn("part", F.lit("unl"))))
    # at most max_positives + max_unlabelled ids: the broadcast is bounded
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picks), "id")
    got = sorted(feature_rows(rows.select("part", "text")).collect(), key=lambda r: (r["part"], xxhash.xxh64_digest(r["x"])))
    part = {k: np.array([np.frombuffer(r["x"], np.float32) for r in got if r["part"] == k], dtype=np.float64)
            .reshape(-1, WIDTH) for k in ("pos", "unl")}
    return nn_pu_fit(part["pos"], part["unl"], estimate_prior(part["pos"], part["unl"]) if prior is None else prior)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns, with the score (P of good quality) appended; a
    column of that name is replaced."""
    docs = replacing(docs, score_col)

    def run(batches):
        shapes = Shapes()
        for b in batches:
            found = [model.score(np.stack([features(r[0], shapes) for r in rows]))
                     for rows in row_chunks([b], [text_col])]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.concatenate(found) if found else [], pa.float64())],
                names=[*b.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
