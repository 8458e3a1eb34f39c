import math
import pickle

import numpy as np
import pandas as pd
import pytest
from oracle_harness import compare
from pyspark.sql import functions as F

from cartlift.llm import topk as K
from cartlift.llm.queries import ORACLES, QUERIES

SF001 = "/root/testdata/sf0.001"


def brute(rows, k):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for p, (q, v) in enumerate(ok):
        if q % 50:
            continue
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for j, (i, w) in enumerate(ok) if j != p)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_query_against_sql(spark):
    ok, said = compare(QUERIES["op10_top_k"](spark, SF001), ORACLES["op10_top_k"], SF001)
    assert ok, said


def test_edges(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 1, 4).tolist()) for i in range(120)]
    rows += [(200, None), (250, [1.0, None, 0.0, 0.0]), (300, [float("nan")] * 4), (350, [float("inf"), 0.0, 0.0, 0.0]),
             (400, [9.0, 9.0, 9.0, 9.0]), (401, [9.0, 9.0, 9.0, 9.0]), (402, [9.0, 9.0, 9.0, 9.0]),   # ties
             (50, rows[50][1]), (450, [1.0]), (None, [1.0] * 4), (500, [])]                           # repeated id, short
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(
        "*", *[F.lit("clash").alias(c) for c in ("id", "v", "query", "rid", "block", "rank", "score")]).repartition(3)
    for block_rows, group in ((8192, 4096), (16, 1)):
        assert got(K.top_k(docs, F.col("vec_id") % 50 == 0, block_rows=block_rows, group_queries=group)) == brute(rows, 5)
    assert K.top_k(docs.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0
    assert got(K.top_k(docs.where("vec_id in (0, 1)"), F.col("vec_id") % 50 == 0)) == brute([rows[0], rows[1]], 5)


@pytest.mark.parametrize("shape", ["normal", "clusters", "same"])
def test_dual_tree_is_exact_and_prunes(shape):
    rng = np.random.default_rng(1)
    n = 3000
    if shape == "clusters":
        pts = (rng.normal(0, 900, (12, 8))[rng.integers(0, 12, n)] + rng.normal(0, 9, (n, 8))).astype(np.int64)
    elif shape == "same":
        pts = np.tile(rng.integers(-99, 99, 8), (n, 1))
    else:
        pts = rng.integers(-300, 300, (n, 8))
    ids = rng.permutation(n) * 3
    block = {"number": 0, "ids": ids, "points": pts, "tree": K.CoverTree(pts)}
    at = np.arange(0, n, 10)
    asked = {"ids": ids[at], "points": pts[at], "place": at, "block": np.zeros(len(at), np.int64), "tree": K.CoverTree(pts[at])}
    scored = []
    best = K.Best.offer

    def counted(self, rows, score, *rest):
        scored.append(score.size)
        best(self, rows, score, *rest)
    K.Best.offer = counted
    try:
        found = K.dual_search(asked, block, 5)
    finally:
        K.Best.offer = best
    s = pts[at] @ pts.T
    for i, a in enumerate(at):
        order = sorted((-s[i, j], ids[j]) for j in range(n) if j != a)[:5]
        assert [(-x, y) for x, y in order] == list(zip(found.score[i].tolist(), found.id[i].tolist()))
    if shape == "clusters":
        assert sum(scored) < 0.7 * s.size


def test_given_vectors_are_pruned():
    """Exact scores taken against all pairs (products with centres, for bounds, come on top)."""
    table = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet").dropna()
    pts = np.floor(256 * np.array(table.embedding.tolist(), dtype=float)).astype(np.int64)
    ids = table.vec_id.to_numpy()
    at = np.flatnonzero(ids % 50 == 0)
    block = {"number": 0, "ids": ids, "points": pts, "tree": K.CoverTree(pts)}
    asked = {"ids": ids[at], "points": pts[at], "place": at, "block": np.zeros(len(at), np.int64),
             "tree": K.CoverTree(pts[at], K.QUERY_LEAF)}
    found = K.dual_search(asked, block, 5)
    share = found.scored / (len(at) * len(pts))
    print("scored share", share, "products for bounds", found.bounded / (len(at) * len(pts)))
    assert share < 0.7
    score = pts[at] @ pts.T
    score[np.arange(len(at)), at] = -10 ** 9
    assert (found.score == -np.sort(-score, axis=1)[:, :5]).all()
    # with its own k-th scores as floor nothing is lost, and less is scored
    again = K.dual_search(asked, block, 5, floor=found.score[:, -1])
    assert (again.score == found.score).all() and (again.id == found.id).all() and again.scored <= found.scored


def test_covering_radii_hold():
    pts = np.random.default_rng(3).normal(0, 10, (2000, 5))
    t = K.CoverTree(pts)
    for start, end, centre, radius, kids in t.nodes:
        own = pts[t.order[start:end]]
        assert np.sqrt(((own - centre) ** 2).sum(1)).max() <= radius * (1 + 1e-9)
        assert not kids or [t.nodes[c][:2] for c in kids][0][0] == start and t.nodes[kids[-1]][1] == end
    assert sorted(t.order) == list(range(2000))


def test_large_integers_stay_exact():
    a = np.array([[2 ** 40, 3], [-(2 ** 40), 1]])
    assert K.exact_products(a, a)[0, 0] == 2 ** 63 - 1  # clipped: a long can't hold 2**80
    b = np.array([[2 ** 30, 1]])
    assert K.exact_products(b, b)[0, 0] == 2 ** 60 + 1


def test_a_tree_travels_without_its_points():
    """What blocks and query groups are written and sent as: node centres are numbers of points."""
    pts = np.random.default_rng(4).integers(-99, 99, (3000, 64))
    tree = K.CoverTree(pts)
    data = pickle.dumps(tree)
    assert len(data) < pts.nbytes / 8
    block = {"number": 0, "ids": np.arange(3000), "points": pts, "tree": tree}
    asked = {"ids": np.arange(9), "points": pts[:9], "place": np.arange(9), "block": np.zeros(9, np.int64), "tree": K.CoverTree(pts[:9])}
    found, again = K.dual_search(asked, block, 5), K.dual_search(asked, {**block, "tree": pickle.loads(data)}, 5)
    assert (found.score == again.score).all() and (found.id == again.id).all()


def test_queries_in_several_batches(spark, monkeypatch):
    """Blocks of a task share one list of the k best; queries are sent batch by batch."""
    rng = np.random.default_rng(5)
    rows = [(i % 290, rng.integers(-3, 3, 3).astype(float).tolist()) for i in range(300)]  # repeated ids, many ties
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(K, "BATCH_CELLS", 9)
    monkeypatch.setattr(K, "BLOCKS_PER_TASK", 2)
    sent = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v: sent.append(v) or broadcast(self, v))
    assert got(K.top_k(docs, F.col("vec_id") % 50 == 0, block_rows=20, group_queries=2)) == brute(rows, 5)
    assert len(sent) > 1


def test_a_further_block_goes_on_from_the_best_of_others():
    rng = np.random.default_rng(6)
    pts = rng.integers(-50, 50, (900, 6))
    ids = np.arange(900)
    blocks = [{"number": b, "ids": ids[b::3], "points": pts[b::3], "tree": K.CoverTree(pts[b::3])} for b in range(3)]
    asked = {"ids": ids[:99], "points": pts[:99], "place": ids[:99] // 3, "block": ids[:99] % 3, "tree": K.CoverTree(pts[:99])}
    best = K.Best(99, 5)
    for b in blocks:
        own = asked["block"] == b["number"]
        before = best.score[own].copy()
        K.dual_search(asked, b, 5, best=best, skip=own)
        assert (best.score[own] == before).all()
        K.dual_search(asked, b, 5, best=best, skip=~own)
    score = pts[:99] @ pts.T
    score[np.arange(99), np.arange(99)] = -10 ** 9
    for i in range(99):
        assert list(zip((-best.score[i]).tolist(), best.id[i].tolist())) == sorted(zip((-score[i]).tolist(), ids.tolist()))[:5]
