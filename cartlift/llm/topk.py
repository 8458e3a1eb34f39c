"""Exact top-k inner-product search with two cover trees.

Vectors are dealt into blocks of bounded size and each block is indexed by a
cover tree: nested nodes with a centre point and the covering radius of its
points, each node's children covering it at half the radius (with at most
``FANOUT`` centres; radii are measured, so every bound holds).  Queries of
several blocks form groups with a tree of their own.  Each pair (query group,
block) is searched by descending both trees together: a pair of nodes is
pruned when

    <cq, cr> + |cq| Rr + |cr| Rq + Rq Rr

is below the worst k-th score of the queries under the query node; leaves that
remain are taken by the bound <q, cr> + |q| Rr of each single query, the most
promising first, until it falls below that query's own k-th score.  A query
gets a k-th score before any pruning: from the leaves nearest to its group in
its own block, which is searched first, and then as a floor in every other
block.  A task searches several blocks one after another and keeps the k best
of each query over all of them; it returns at most k rows a query, none below
that floor; a window over these takes the final k.

Blocks are written once, packed, and stay where they are: what moves to them
are the queries, broadcast in batches of ``BATCH_CELLS`` vector components.  A
task holds one batch and one block, and the driver one batch, however many
vectors and queries there are.

The components are integers, so scores are exact; the bound is rounded up.
Products whose sum could pass 2**53 are computed in Python integers.

Defined cases: vectors that are null or hold a null or non-finite component
take no part; a shorter vector counts as padded with zeros; a row never
matches itself, but another row with the same id may; ties go to the smaller
id, then to either; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import math
import pickle
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlift.llm.common import materialize

FANOUT = 32
LEAF = 8             # points of a block's leaf
QUERY_LEAF = 64      # queries that descend a block's tree together
CELLS = 4_000_000    # vector components gathered at once
BATCH_CELLS = 8_000_000   # vector components of the queries sent to all tasks at once
BLOCKS_PER_TASK = 32
SLACK = 1e-9         # relative, of a bound's largest possible size; rounding can only make a bound larger
LOWEST, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class CoverTree:
    """Points in tree order with nodes (start, end, centre, radius, children).

    A node's first child keeps its centre; the others' centres are points of
    the node, each the farthest from the centres before it.  Pickled, a tree is
    ``order`` and ``flat`` alone: it names its points by number."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points.astype(np.float64), leaf
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, np.ndarray, float, list[int]]] = []
        self._at: list[int] = []
        if len(points):
            mean = ((self.points - self.points.mean(axis=0)) ** 2).sum(1)
            self._build(0, len(points), int(np.argmin(mean)))

    @cached_property
    def flat(self) -> dict[str, np.ndarray]:
        """The nodes as arrays: span, point at the centre, radius, number of
        children and the children in a row (a leaf has itself in their place)."""
        kids = [n[4] or [i] for i, n in enumerate(self.nodes)]
        many = np.array([len(x) for x in kids], dtype=np.int32)
        return {"span": np.array([n[:2] for n in self.nodes], dtype=np.int32).reshape(-1, 2),
                "at": np.array(self._at, dtype=np.int32), "radius": np.array([n[3] for n in self.nodes], dtype=np.float64),
                "leaf": np.array([not n[4] for n in self.nodes], dtype=bool), "many": many,
                "first": np.cumsum(many, dtype=np.int32) - many,
                "kids": np.array([x for own in kids for x in own], dtype=np.int32)}

    def __getstate__(self) -> dict:
        return {"leaf": self.leaf, "order": self.order.astype(np.int32), "flat": self.flat}

    def _build(self, start: int, end: int, at: int) -> int:
        """Node over the places start..end around the point ``at``."""
        rows = self.order[start:end]
        own, centre = self.points[rows], self.points[at]
        dist = np.sqrt(((own - centre) ** 2).sum(1))
        radius = float(dist.max())
        here = len(self.nodes)
        self.nodes.append((start, end, centre, radius * (1 + 1e-12), []))
        self._at.append(at)
        if end - start <= self.leaf:
            return here
        centres, label, near = [at], np.zeros(end - start, np.int64), dist
        if radius == 0:                                  # equal points: leaves of their own
            label = np.arange(end - start) // self.leaf
            centres = rows[::self.leaf].tolist()
            if len(centres) > FANOUT:
                label, centres = label * FANOUT // len(centres), centres[:FANOUT]
        else:
            for c in range(1, FANOUT):
                far = int(np.argmax(near))
                if near[far] <= radius / 2:
                    break
                d = np.sqrt(((own - own[far]) ** 2).sum(1))
                closer = d < near
                label[closer], near = c, np.minimum(d, near)
                centres.append(int(rows[far]))
        by = np.argsort(label, kind="stable")
        self.order[start:end] = rows[by]
        at_place = start
        for c, n in enumerate(np.bincount(label, minlength=len(centres)).tolist()):
            if n:
                self.nodes[here][4].append(self._build(at_place, at_place + n, centres[c]))
                at_place += n
        return here


def _exact_in_float(a: np.ndarray, b: np.ndarray, bits: int = 53) -> bool:
    """Whether all inner products of the rows of a and b are exact in doubles
    (with 24 bits: in single precision)."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2.0 ** bits


def _clipped(exact: np.ndarray) -> np.ndarray:
    """Python integers as longs, held to their range."""
    return np.clip(exact, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b."""
    if _exact_in_float(a, b):
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return _clipped(a.astype(object) @ b.astype(object).T)


class Best:
    """The k best (score, id) of each query so far: score down, id up.  Only
    scores of at least ``floor``, a query's k-th score elsewhere, are taken."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.score = np.full((n, k), LOWEST)
        self.id = np.full((n, k), NO_ID)
        self.floor = np.full(n, LOWEST) if floor is None else floor
        self.scored = 0     # exact scores taken
        self.bounded = 0    # inner products taken for bounds

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def offer(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates as (query, score, id), each at most once."""
        held = self.score[row, -1]
        better = (score >= self.floor[row]) & ((score > held) | ((score == held) & (ids < self.id[row, -1])))
        row, score, ids = row[better], score[better], ids[better]
        if not len(row):
            return
        who = np.unique(row)
        place = np.concatenate([np.searchsorted(who, row), np.repeat(np.arange(len(who)), self.k)])
        s = np.concatenate([score, self.score[who].ravel()])
        i = np.concatenate([ids, self.id[who].ravel()])
        by = np.lexsort((i, ~s, place))
        take = by[np.searchsorted(place[by], np.arange(len(who)))[:, None] + np.arange(self.k)[None, :]]
        self.score[who], self.id[who] = s[take], i[take]


def dual_search(queries: dict, block: dict, k: int, floor: np.ndarray | None = None, best: Best | None = None,
                skip: np.ndarray | None = None) -> Best:
    """Top k of each query among the block's points, but for those below ``floor``.
    ``best`` has the queries' best of other blocks, which it goes on from;
    queries marked in ``skip`` are left as they are."""
    width = max(queries["points"].shape[1], block["points"].shape[1])
    q, r = _padded(queries["points"], width), _padded(block["points"], width)
    qt, rt = queries["tree"].flat, block["tree"].flat
    q_order, r_order = queries["tree"].order, block["tree"].order
    best = Best(len(q), k, floor) if best is None else best
    wanted = np.ones(len(q), bool) if skip is None else ~skip
    if not wanted.any() or not len(r):
        return best
    kind = np.float32 if _exact_in_float(q, r, 24) else np.float64 if _exact_in_float(q, r) else object
    qf, rf = q.astype(kind), r[r_order].astype(kind)                     # the block's points in tree order
    ids = block["ids"][r_order]
    q_real = q.astype(np.float64)
    norm = np.linalg.norm(q_real, axis=1)
    qc, rc = q_real[qt["at"]], r[rt["at"]].astype(np.float64)
    q_far, r_norm = norm[qt["at"]] + qt["radius"], np.linalg.norm(rc, axis=1)
    # a node's radius, with what rounding may take from a bound
    r_radius = rt["radius"] + SLACK * (r_norm + rt["radius"])
    reach = np.column_stack([qc, q_far, qt["radius"]]) @ np.column_stack([rc, r_radius, r_norm]).T
    reach += 1
    best.bounded += reach.size
    groups, leaf_no = np.flatnonzero(qt["leaf"]), np.flatnonzero(rt["leaf"])
    leaf_start, leaf_size = rt["span"][leaf_no, 0].astype(np.int64), np.diff(rt["span"][leaf_no])[:, 0]

    def score_leaves(rows: np.ndarray, leaves: np.ndarray) -> None:
        """Exact scores of pairs (query, leaf)."""
        step = max(1, CELLS // (int(leaf_size.max()) * max(1, width)))
        for at in range(0, len(rows), step):
            size = leaf_size[leaves[at:at + step]]
            row, ends = np.repeat(rows[at:at + step], size), np.cumsum(size)
            pts = np.arange(len(row)) + np.repeat(leaf_start[leaves[at:at + step]] - ends + size, size)
            if kind is object:
                score = _clipped((rf[pts] * qf[row]).sum(-1))
            else:
                score = np.einsum("ij,ij->i", rf[pts], qf[row]).astype(np.int64)
            best.scored += len(score)
            ok = (queries["block"][row] != block["number"]) | (queries["place"][row] != r_order[pts])
            best.offer(row[ok], score[ok], ids[pts[ok]])

    # a k-th score for each query first: from the leaves nearest to its group's centre
    n_seeds = min(len(leaf_no), 1 + -(-2 * k // LEAF))
    near = qc[groups] @ rc[leaf_no].T
    seeds = np.argpartition(-near, n_seeds - 1, axis=1)[:, :n_seeds]
    group_of, order = np.empty(len(q), np.int64), q_order[wanted[q_order]]   # queries in tree order
    for i, (start, end) in enumerate(qt["span"][groups]):
        group_of[q_order[start:end]] = i
    score_leaves(np.repeat(order, n_seeds), seeds[group_of[order]].ravel())
    # both trees together: the block's leaves that a group of queries can't do without
    open_leaves = np.zeros(near.shape, bool)
    group_no, leaf_at = (np.cumsum(t["leaf"]) - 1 for t in (qt, rt))
    worst = np.where(wanted, best.worst(np.arange(len(q))), np.inf)[q_order]
    limit = np.array([worst[start:end].min() for start, end in qt["span"]])
    stack = [(np.zeros(1, np.int32), np.zeros(1, np.int32))]
    while stack:
        a, b = stack.pop()
        kept = reach[a, b] >= limit[a]
        a, b = a[kept], b[kept]
        both = qt["leaf"][a] & rt["leaf"][b]
        open_leaves[group_no[a[both]], leaf_at[b[both]]] = True
        a, b = a[~both], b[~both]
        if not len(a):
            continue
        pairs = np.cumsum(qt["many"][a].astype(np.int64) * rt["many"][b])
        parts = np.searchsorted(pairs, np.arange(CELLS // 8, pairs[-1], CELLS // 8))
        for x, y in zip(*(np.split(v, np.unique(parts)) for v in (a, b))):
            n = qt["many"][x].astype(np.int64) * rt["many"][y]
            which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x, y = np.repeat(x, n), np.repeat(y, n)
            if len(x):
                stack.append((qt["kids"][qt["first"][x] + which // rt["many"][y]],
                              rt["kids"][rt["first"][y] + which % rt["many"][y]]))
    open_leaves[np.arange(len(groups))[:, None], seeds] = False
    # leaves by the bound of each single query, the most promising first
    chunk = max(1, min(256, CELLS // len(leaf_no)))
    for at in range(0, len(order), chunk):
        rows = order[at:at + chunk]
        left = open_leaves[group_of[rows]]
        used = np.flatnonzero(left.any(axis=0))
        if not len(used):
            continue
        bound = np.column_stack([q_real[rows], norm[rows]]) @ np.column_stack([rc, r_radius])[leaf_no[used]].T
        bound += 1
        best.bounded += bound.size
        bound[~left[:, used]] = -np.inf
        ranked = np.argsort(-bound, axis=1)
        done, many = 0, 1
        alive = np.arange(len(rows))
        while done < len(used) and len(alive):
            part = ranked[alive, done:done + many]
            best_left = bound[alive[:, None], part]
            use = (best_left >= best.worst(rows[alive])[:, None]) & (best_left > -np.inf)
            alive = alive[use[:, 0]]            # bounds fall along a row: once below, all further ones are
            part, use = part[use[:, 0]], use[use[:, 0]]
            i, j = np.nonzero(use)
            score_leaves(rows[alive[i]], used[part[i, j]])
            done += many
            many = min(2 * many, 32)
    return best


def _padded(points: np.ndarray, width: int) -> np.ndarray:
    return points if points.shape[1] == width else np.pad(points, ((0, 0), (0, width - points.shape[1])))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of longs as rows, the shorter ones filled up with zeros."""
    lists = lists.combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(index: dict) -> bytes:
    """A block's or a query group's arrays, its points as integers of the fewest bytes."""
    points = index["points"]
    low, high = points.min(initial=0), points.max(initial=0)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return pickle.dumps({**index, "points": points.astype(kind)})


def _unpacked(data: bytes) -> dict:
    index = pickle.loads(data)
    return {**index, "points": index["points"].astype(np.int64)}


def _rows_found(queries: dict, score: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """The places of ``score`` and ``ids`` (query x k) that hold a candidate, as rows."""
    who, at = np.nonzero(ids != NO_ID)
    row = queries["block"][who] * (1 << 32) + queries["place"][who]
    return pa.RecordBatch.from_arrays(
        [pa.array(queries["ids"][who], pa.int64()), pa.array(row, pa.int64()), pa.array(ids[who, at], pa.int64()),
         pa.array(score[who, at], pa.int64())], names=["query_id", "row", "vec_id", "score"])


def integer_vectors(vectors: DataFrame, vec_col: str = "embedding", factor: int = 256) -> DataFrame:
    """Rows whose vector counts, with the column ``v`` of floor(factor * x)."""
    ok = F.col(vec_col).isNotNull() & F.forall(
        vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(ok).withColumn(
        "v", F.transform(vec_col, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long")))


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          factor: int = 256, block_rows: int = 8192, group_queries: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query.

    ``is_query`` is a boolean column over the table; all its rows are queries
    and every other row of the table is a candidate of each.  Rows without an id
    are neither queries nor candidates.
    """
    rows = integer_vectors(vectors.withColumn("__query", F.coalesce(is_query, F.lit(False))), vec_col, factor).where(
        F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), "v", F.col("__query").alias("query"),
        F.size(vec_col).alias("width"), F.monotonically_increasing_id().alias("rid"))
    n, n_queries, width = rows.agg(F.count(F.lit(1)), F.count_if("query"), F.max("width")).first()
    blocks = max(1, math.ceil(n / block_rows))
    groups = max(1, min(blocks, math.ceil(n_queries / group_queries)))
    spark = vectors.sparkSession

    def build(t: pa.Table) -> pa.Table:
        number = t.column("block")[0].as_py()
        points = _matrix(t.column("v"))
        ids, query = t.column("id").to_numpy(), t.column("query").to_numpy()
        block = {"number": number, "ids": ids, "points": points, "tree": CoverTree(points)}
        at = np.flatnonzero(query)
        asked = {"ids": ids[at], "points": points[at], "place": at, "block": np.full(len(at), number)}
        own = dual_search({**asked, "tree": CoverTree(points[at], QUERY_LEAF)}, block, k)
        block |= {"asked": at, "score": own.score, "id": own.id}
        asked["floor"] = own.score[:, -1]
        return pa.table({"block": pa.array([number], pa.int32()), "index": pa.array([_packed(block)], pa.binary()),
                         "asked": pa.array([_packed(asked)], pa.binary())})

    # blocks are dealt by a hash of the row number: no block depends on how ids or vectors repeat
    indexed = materialize(rows.select("id", "v", "query", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block"))
                          .groupBy("block").applyInArrow(build, "block int, index binary, asked binary"), "vector_blocks")

    def join_parts(t: pa.Table) -> pa.Table:
        parts = [_unpacked(p) for p in t.column("asked").to_pylist()]
        width = max(p["points"].shape[1] for p in parts)
        group = {"points": np.concatenate([_padded(p["points"], width) for p in parts]),
                 **{c: np.concatenate([p[c] for p in parts]) for c in ("ids", "place", "block", "floor")}}
        group["tree"] = CoverTree(group["points"], QUERY_LEAF)
        return pa.table({"grp": t.column("grp").slice(0, 1), "asked": pa.array([_packed(group)], pa.binary())})

    asked = materialize(indexed.select(F.pmod("block", F.lit(groups)).alias("grp"), "asked")
                        .groupBy("grp").applyInArrow(join_parts, "grp int, asked binary"), "query_groups")
    parallel = spark.sparkContext.defaultParallelism
    tasks = min(blocks, max(4 * parallel, math.ceil(blocks / BLOCKS_PER_TASK)))
    dealt = indexed.select("block", "index")
    dealt = (dealt.repartitionByRange(tasks, "block") if tasks > 1 else dealt).select("index")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    at_once = max(1, BATCH_CELLS // (max(1, width or 0) * max(1, math.ceil(n_queries / groups))))

    def best_of(first: int) -> DataFrame:
        """The k best of the queries of some groups, over all blocks."""
        own = asked.where(F.col("grp").between(first, first + at_once - 1)).select("asked")
        sent = spark.sparkContext.broadcast([bytes(r[0]) for r in own.collect()])

        def search(batches):
            queries = [_unpacked(g) for g in sent.value]
            best = [Best(len(g["ids"]), k, g["floor"]) for g in queries]
            for b in batches:
                for i in range(b.num_rows):
                    block = _unpacked(b.column(0)[i].as_py())
                    for g, found in zip(queries, best):
                        here = g["block"] == block["number"]      # searched when the block was built
                        at, = np.nonzero(here)
                        place = np.searchsorted(block["asked"], g["place"][at])
                        ids, row = block["id"][place].ravel(), np.repeat(at, k)
                        held = ids != NO_ID
                        found.offer(row[held], block["score"][place].ravel()[held], ids[held])
                        dual_search(g, block, k, best=found, skip=here)
            for g, found in zip(queries, best):
                yield _rows_found(g, found.score, found.id)

        found = dealt.mapInArrow(search, "query_id long, row long, vec_id long, score long")
        top = materialize(found.withColumn("rank", rank).where(F.col("rank") <= k)
                          .select("query_id", "rank", "vec_id", "score"), "vector_hits")
        sent.destroy()
        return top

    parts = [best_of(g) for g in range(0, groups, at_once)]
    return reduce(DataFrame.unionAll, parts)
