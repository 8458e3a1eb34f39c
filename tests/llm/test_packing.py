import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from edge_tables import ROWS, documents, edge_docs, empty_docs, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartlift.llm import packing as K
from cartlift.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF001 = "/root/testdata/sf0.001"


def check_packing(pieces, texts, capacity=2048):
    """Pieces must give every document's ids, in gapless sequences."""
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    want = Counter()
    for d, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        at = 0
        for k, n in enumerate(K.cut(len(ids), capacity)):
            want[(d, k, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes()))] += 1
            at += n
        assert at == len(ids)
    assert want == Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for rows in sequences.values():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_query(spark):
    d = documents(SF001)
    pieces = QUERIES["op9_best_fit_packing"](spark, SF001).collect()
    used = check_packing(pieces, list(zip(d.doc_id.tolist(), d.text)))
    counts = Counter(p["length"] for p in pieces if p["length"] < 2048)
    full = sum(p["length"] == 2048 for p in pieces)
    assert used - full <= K.lower_bound(counts, 2048) * 1.01 + 1


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_edges(spark, capacity):
    docs = edge_docs(spark)
    pieces = K.pack(with_clashes(docs).drop("offset"), PATH, capacity).collect()
    check_packing(pieces, [(r[0], r[1]) for r in ROWS], capacity)
    assert K.pack(empty_docs(spark), PATH, capacity).count() == 0


def test_ids_can_be_kept(spark):
    for p in K.pack(edge_docs(spark), PATH, 64, with_ids=True).collect():
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"]


def fewest(lengths, capacity):
    """Optimal number of bins by exhaustive search."""
    best = len(lengths)

    def go(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for i in sorted(set(range(len(rooms))), key=lambda i: rooms[i]):
            if rooms[i] >= rest[0]:
                go(rest[1:], [*rooms[:i], rooms[i] - rest[0], *rooms[i + 1:]])
        go(rest[1:], [*rooms, capacity - rest[0]])
    go(sorted(lengths, reverse=True), [])
    return best


def check_plan(plan, counts, capacity):
    used = Counter()
    for times, pattern in plan.patterns:
        assert times > 0 and sum(l * k for l, k in pattern.items()) <= capacity
        for l, k in pattern.items():
            used[l] += k * times
    assert used == Counter(counts)
    assert plan.sequences == sum(t for t, _ in plan.patterns) >= plan.bound


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plans_are_optimal(lengths):
    plan = K.bin_completion(dict(Counter(lengths)), 20)
    check_plan(plan, Counter(lengths), 20)
    assert plan.proven and plan.sequences == fewest(lengths, 20)


def test_branching_improves_on_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # 6+4, 5+5, 3+3+4, 6+2+2 in capacity 10
    n = K.bin_completion(counts, 10).sequences
    assert n == fewest([6, 6, 5, 5, 4, 4, 3, 3, 2, 2], 10) == 4


@pytest.mark.parametrize("times", [1, 7, 1000])
def test_optimum_of_repeated_lengths(times):
    counts = {l: n * times for l, n in {8: 1, 5: 3, 4: 2, 3: 3}.items()}  # 8+5+4+3 and 5+5+4+3+3
    plan = K.bin_completion(counts, 20)
    check_plan(plan, counts, 20)
    assert plan.sequences == 2 * times and plan.proven


def test_search_ends_with_its_steps():
    rng = np.random.default_rng(0)
    counts = Counter(rng.integers(300, 900, 600).tolist())
    plan = K.bin_completion(counts, 2048, steps=1000)
    check_plan(plan, counts, 2048)
    assert plan.sequences == sum(t for t, _ in K.best_fit(counts, 2048))
    longer = K.bin_completion(counts, 2048)
    check_plan(longer, counts, 2048)
    assert longer.sequences <= plan.sequences
