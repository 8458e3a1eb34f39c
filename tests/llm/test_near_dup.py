from collections import Counter, defaultdict

import numpy as np
import pytest
from edge_tables import ROWS, documents, edge_docs, empty_docs, rows_of, with_clashes

from cartlift.llm import near_dup as N
from cartlift.llm.common import ASCII_FOLD, WordHashes
from cartlift.llm.components import connected_components
from conftest import SF001

COLS = ["doc_id", "n_shingles", "component_id", "kept"]


def shingles(text, width):
    w = (text or "").translate(ASCII_FOLD).encode().split()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent=80):
    """(id, set size, smallest id reachable) of each row, by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                comp[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in ids[root(i)] if x is not None]
        out.append((d, len(sets[i]), d if not sets[i] else min(known, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [2, 5])
def test_edges(spark, width):
    got = N.near_duplicates(edge_docs(spark), width=width)
    assert rows_of(got, *COLS[:3]) == brute([(r[0], r[1]) for r in ROWS], width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_matches_brute_force(spark):
    d = documents(SF001)
    got = N.near_duplicates(spark.read.parquet(f"{SF001}/documents.parquet"), width=2)
    assert rows_of(got, *COLS[:3]) == brute(list(zip(d.doc_id.tolist(), d.text)), 2)


def test_empty_and_clashes(spark):
    assert N.near_duplicates(empty_docs(spark)).count() == 0
    assert rows_of(N.near_duplicates(with_clashes(edge_docs(spark))), *COLS) == rows_of(N.near_duplicates(edge_docs(spark)), *COLS)


def test_family_without_a_centre(spark):
    """A chain in which only neighbours are similar, and a dense group whose
    members share buckets, must come out whole."""
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[4 * i:4 * i + 60])) for i in range(60)]
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    dense = []
    for i in range(150):
        w = list(base)
        for j in rng.choice(120, 4, replace=False):
            w[j] = f"x{i}_{j}"
        dense.append((1000 + i, " ".join(w)))
    rows = chain + dense
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    assert rows_of(got, *COLS[:3]) == brute(rows, 2)


def test_blocks_find_what_hubs_miss(spark, monkeypatch):
    """Families compared in many small blocks give the same links."""
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = np.random.default_rng(6)
    rows = []
    for f in range(6):  # families at about 0.7 around a base, with close pairs inside
        base = [f"f{f}_{i}" for i in range(80)]
        for m in range(10):
            w = list(base)
            for j in rng.choice(80, 9, replace=False):
                w[j] = f"y{f}_{m}_{j}"
            rows += [(100 * f + 2 * m, " ".join(w)), (100 * f + 2 * m + 1, " ".join(w[:-1] + [f"z{m}"]))]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    assert rows_of(got, *COLS[:3]) == brute(rows, 2)


def test_sketch_limit_keeps_pairs_at_the_threshold():
    signer, rng = N.Signer(), np.random.default_rng(1)
    limit = N.sketch_limit(80, N.BANDS * N.ROWS, N.BITS)
    counts = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 2 ** 63, n, dtype=np.uint64) for n in (160, 20, 20))  # exactly 0.8
        s = [signer.sketch(signer.samples(np.unique(np.concatenate([both, x])))) for x in (a, b)]
        counts.append(int(np.bitwise_count(s[0] ^ s[1]).sum()))
    assert max(counts) <= limit and np.mean(counts) < limit * 0.75
    far = [int(np.bitwise_count(signer.sketch(signer.samples(rng.integers(0, 2 ** 63, 200, dtype=np.uint64)))
                                ^ signer.sketch(signer.samples(rng.integers(0, 2 ** 63, 200, dtype=np.uint64)))).sum())
           for _ in range(20)]
    assert min(far) > limit


def test_similarity_is_exact_at_the_border():
    h = WordHashes()
    a = N.shingle_set("a b c d e", 1, h)
    assert N.similar(a, N.shingle_set("a b c d", 1, h), 80)
    assert not N.similar(a, N.shingle_set("a b c f", 1, h), 80)
    assert Counter(map(len, (N.shingle_set(t, 2, h) for t in ("", "one", "one two", None)))) == Counter([0, 1, 1, 0])


def test_components_of_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(6, 60)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(5, 60)} == {5}
