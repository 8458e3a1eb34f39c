"""Boosted trees fitted inside Spark tasks, each on the rows of one member of a model.

``spark.ml`` runs a few jobs for each level of each tree.  On the rows of one
experiment that overhead is the whole cost of 500 rounds, and a cross-fitted
meta-learner needs a dozen such models.  Here every (model, member) is one
group of one shuffle: its task bins the rows and boosts trees on histograms
(logistic loss, Newton leaf values with an L2 term, minimum leaf size, a new
column subset for each tree).  A missing value has a bin of its own and each
split learns the side it goes to, so nothing is imputed.

A model of many rows is a *committee*: all its rows are dealt by a keyed hash
into members of about ``member_rows`` rows, whose probabilities are averaged.
There are ``members`` of them at most, so the fitted trees and the cost of
scoring a row stay bounded however large the table is; a model of more rows
than ``members`` times ``member_rows`` has larger members, and a task's memory
and time grow with the rows of one of them.
"""

from __future__ import annotations

import io
from functools import cached_property

import numpy as np

NO_GAIN = 1e-12      # a split must gain more
BINS = 64            # value bins of a feature, one of them for missing values


def bin_edges(column: np.ndarray, bins: int = BINS) -> np.ndarray:
    """At most ``bins - 2`` cut points: a value belongs to the bin whose number
    is the count of cut points below it."""
    known = np.sort(column[~np.isnan(column)])
    if not len(known):
        return np.zeros(0)
    at = (np.arange(1, bins - 1) * len(known)) // (bins - 1)
    edges = np.unique(known[at])
    return edges[edges < known[-1]]


def _codes(x: np.ndarray, edges: list[np.ndarray], bins: int) -> np.ndarray:
    """Bin numbers, a column's in a row, in the narrowest type."""
    out = np.empty(x.shape[::-1], np.min_scalar_type(bins - 1))
    for j, e in enumerate(edges):
        out[j] = np.where(np.isnan(x[:, j]), bins - 1, np.searchsorted(e, x[:, j], side="left"))
    return out


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-m))


class Trees:
    """Complete trees of one depth: inner nodes in level order, then leaves."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, missing_left: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.missing_left, self.leaf = base, feature, cut, missing_left, leaf

    @cached_property
    def _tests(self) -> tuple[list[tuple[int, bool, np.ndarray]], np.ndarray]:
        """The distinct tests as (column, missing goes left, its cuts), and each
        node's number among them; many nodes share one test."""
        at = np.stack([self.feature.ravel(), self.missing_left.ravel(), self.cut.ravel()], axis=1)
        distinct, number = np.unique(at, axis=0, return_inverse=True)
        starts = [0, *(np.flatnonzero((distinct[1:, :2] != distinct[:-1, :2]).any(1)) + 1).tolist(), len(distinct)]
        groups = [(int(distinct[i, 0]), bool(distinct[i, 1]), distinct[i:k, 2:]) for i, k in zip(starts, starts[1:]) if i < k]
        return groups, number.reshape(self.feature.shape)

    def probability(self, x: np.ndarray, rows: int = 1024, trees_at_once: int = 32) -> np.ndarray:
        """p(y = 1) of each row of ``x`` (NaN: missing), some rows at a time.

        Each distinct test is made once for a row; a tree's path is then read
        from the answers, whole blocks of trees and rows in one operation."""
        trees, inner = self.feature.shape
        depth = (inner + 1).bit_length() - 1
        groups, number = self._tests
        first_leaf = (np.arange(trees) * (inner + 1))[:, None]
        out = np.empty(len(x))
        for s in range(0, len(x), rows):
            part = np.ascontiguousarray(x[s:s + rows].T)
            right = np.concatenate([part[f] > cuts if missing_left else ~(part[f] <= cuts) for f, missing_left, cuts in groups])
            values = np.empty((trees, part.shape[1]))
            for t in range(0, trees, trees_at_once):
                turns = []  # at each level: the row goes right
                place = np.zeros((), np.min_scalar_type(inner))  # the leaf's number, its first binary digit first
                for d in range(depth):
                    went = [right[number[t:t + trees_at_once, node]] for node in range(2 ** d - 1, 2 ** (d + 1) - 1)]
                    for turn in turns:
                        half = len(went) // 2
                        went = [a ^ ((a ^ b) & turn) for a, b in zip(went[:half], went[half:])]
                    turns += went
                    place = place * 2 + went[0]
                self.leaf.take(first_leaf[t:t + trees_at_once] + place, out=values[t:t + trees_at_once], mode="clip")  # never out of range; "raise" would copy
            out[s:s + rows] = _sigmoid(self.base + np.ascontiguousarray(values.T).sum(1))
        return out

    def dumps(self) -> bytes:
        f = io.BytesIO()
        np.savez_compressed(f, base=self.base, feature=self.feature, cut=self.cut, missing_left=self.missing_left, leaf=self.leaf)
        return f.getvalue()

    @staticmethod
    def loads(data: bytes) -> Trees:
        z = np.load(io.BytesIO(data))
        return Trees(float(z["base"]), z["feature"], z["cut"], z["missing_left"], z["leaf"])


def _best_splits(g: np.ndarray, h: np.ndarray, n: np.ndarray | None, l2: float, min_leaf: int):
    """Best (column, bin, missing goes left, gain) of each node from its
    histograms of shape (nodes, columns, bins), the last bin being missing, and
    the smaller side's sum of ``h``.  Without row counts no leaf is too small."""
    def score(a, b):
        return a * a / (b + l2)

    def sides(hist):
        low = np.cumsum(hist[:, :, :-1], axis=2)[:, :, :-1]
        return np.stack([low, low + hist[:, :, -1:]], axis=-1)  # missing on the right, on the left

    def total(hist):
        return hist[:, 0, :].sum(1)[:, None, None, None]

    tg, th, lg, lh = total(g), total(h), sides(g), sides(h)
    gain = score(lg, lh) + score(tg - lg, th - lh) - score(tg, th)
    if n is not None:
        tn, ln = total(n), sides(n)
        gain[(ln < min_leaf) | (tn - ln < min_leaf)] = -np.inf
    flat, node = gain.reshape(len(gain), -1), np.arange(len(gain))
    best = flat.argmax(1)
    column, cut, left = np.unravel_index(best, gain.shape[1:])
    smaller = np.minimum(lh, th - lh).reshape(flat.shape)[node, best]
    return column, cut, left.astype(bool), flat[node, best], smaller


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 500, step: float = 0.05, depth: int = 3, min_leaf: int = 30,
          column_share: float = 0.8, l2: float = 1.0, seed: int = 42, bins: int = BINS) -> Trees:
    """Gradient-boosted trees for P(y = 1); NaN is a missing value."""
    n, f = x.shape
    edges = [bin_edges(x[:, j], bins) for j in range(f)]
    codes = _codes(x, edges, bins)  # a column's histogram reads its codes in a row
    padded = np.full((f, bins), np.inf)  # the cut after a bin's last edge is never chosen
    for j, e in enumerate(edges):
        padded[j, :len(e)] = e
    rng, inner, take = np.random.default_rng(seed), 2 ** depth - 1, max(1, round(column_share * f))
    p = min(max(y.mean(), 1e-6), 1 - 1e-6) if n else 0.5
    base = float(np.log(p / (1 - p)))
    margin, rows = np.full(n, base), np.arange(n)

    def by_node(sums: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(sums.reshape(take, -1, bins).transpose(1, 0, 2))

    feature, cut = np.zeros((rounds, inner), np.int32), np.full((rounds, inner), np.inf)
    missing_left, leaf = np.ones((rounds, inner), bool), np.zeros((rounds, inner + 1))
    for r in range(rounds if n else 0):
        prob = _sigmoid(margin)
        g, h = prob - y, prob * (1 - prob)
        cols = np.sort(rng.choice(f, take, replace=False))
        gh = g + 1j * h  # one pass sums both; each part adds up as it would alone
        node = np.zeros(n, np.int64)
        for d in range(depth):
            first, width = 2 ** d - 1, 2 ** d
            size = width * bins
            start = (node - first) * bins
            sums = np.zeros((take, size), complex)
            at = np.empty(n, np.int64)
            for j, column in enumerate(cols):
                np.add.at(sums[j], np.add(codes[column], start, out=at) if d else codes[column], gh)  # at the root the codes are the places
            hg, hh = (by_node(a) for a in (sums.real, sums.imag))
            col, c, left, gain, smaller = _best_splits(hg, hh, None, l2, min_leaf)
            # no row adds over 1/4 to h, so rows are counted only where h leaves a side's size open
            if not ((gain <= NO_GAIN) | (4 * smaller >= min_leaf * (1 + 1e-9))).all():
                hn = by_node(np.stack([np.bincount(np.add(codes[column], start, out=at), minlength=size) for column in cols]))
                col, c, left, gain, _ = _best_splits(hg, hh, hn, l2, min_leaf)
            split = gain > NO_GAIN
            who = first + np.arange(width)
            feature[r, who] = np.where(split, cols[col], 0)
            cut[r, who] = np.where(split, padded[cols[col], c], np.inf)
            missing_left[r, who] = np.where(split, left, True)  # an unsplit node sends all rows left
            goes_left = np.where(np.arange(bins) == bins - 1, left[:, None], np.arange(bins) <= c[:, None]) | ~split[:, None]
            own = codes.ravel().take((cols[col] * n)[node - first] + rows)
            go_left = goes_left.ravel().take(start + own)
            node = 2 * node + 2 - go_left
        sums_g = np.bincount(node - inner, g, inner + 1)
        sums_h = np.bincount(node - inner, h, inner + 1)
        leaf[r] = -step * sums_g / (sums_h + l2)
        margin += leaf[r][node - inner]
    return Trees(base, feature, cut, missing_left, leaf)
