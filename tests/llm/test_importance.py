import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from edge_tables import ROWS, edge_docs, empty_docs, rows_of, with_clashes

from cartlift.llm import importance as I
from cartlift.llm.common import ASCII_FOLD

COLS = ["doc_id", "n_features", "weight", "score", "rank"]
TARGET = [("alpha beta gamma lorem ipsum",), (None,), ("été straße 12345",)]


def features(text, max_n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_FOLD))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, max_n=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, max_n)[1])
    t = Counter(bucket(f) for (x,) in target for f in features(x, max_n)[1])
    ns, nt = s.total() + buckets, t.total() + buckets
    out, enough = [], []
    for i, (d, text) in enumerate(rows):
        n, fs = features(text, max_n)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * ns / ((s[b] + 1) * nt))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(fs), weight, score, None])
        if n >= min_words:
            enough.append((-score, d is not None, d or 0, i))
    for r, (*_, i) in enumerate(sorted(enough)[:len(enough) * percent // 100], 1):
        out[i][4] = r
    return sorted(map(tuple, out), key=repr)


def test_crc_of_all_lengths():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in
             [0, 1, 1, 2, 5, 5, 255, 256, 257, 511, 512, 513, 768, 5000, 5000, 100_003]]
    assert I.crc32_all(words).tolist() == [zlib.crc32(w) for w in words]
    assert I.crc32_all([]).tolist() == []


def test_word_bytes():
    text = "Ab-c d9_ÉTÉ x'y\x7fZ\n\U0001F600"
    assert text.encode().translate(I.FOLD).split() == [w.encode() for w in features(text, 1)[1]]


def test_bucket_memory_is_bounded():
    table = I.Buckets(97, limit=10)
    for i in range(50):
        words = [b"w%d" % (i + j) for j in range(8)]
        assert table.of(words).tolist() == [zlib.crc32(w) % 97 for w in words]
        assert len(table) <= 10


@pytest.mark.parametrize("max_n", [1, 2])
def test_edges(spark, max_n):
    args = dict(max_n=max_n, min_words=2, percent=50)
    got = I.resample(edge_docs(spark), spark.createDataFrame(TARGET, "text string"), **args)
    want = brute([(r[0], r[1]) for r in ROWS], TARGET, **args)
    assert rows_of(got, *COLS[:4]) == sorted((w[:4] for w in want), key=repr)
    # of equal rows either may hold a rank
    assert sorted((r[4], r[0]) for r in want if r[4]) == sorted((r["rank"], r["doc_id"]) for r in got.where("rank > 0").collect())


def test_empty_and_clashes(spark):
    target = spark.createDataFrame(TARGET, "text string")
    assert I.resample(empty_docs(spark), target).count() == 0
    assert I.resample(edge_docs(spark), target.limit(0)).count() == len(ROWS)
    clash = with_clashes(edge_docs(spark)).selectExpr("*", "1 as weight", "2 as row", "3 as rank", "4 as n_words")
    assert rows_of(I.resample(clash, target), *COLS[:4]) == rows_of(I.resample(edge_docs(spark), target), *COLS[:4])


def test_draw_prefers_the_target(spark):
    rng = np.random.default_rng(8)
    near, far = [f"near{i}" for i in range(40)], [f"far{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(near if i % 5 == 0 else far, 30))) for i in range(500)]
    target = [(" ".join(rng.choice(near, 200)),)]
    got = I.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(target, "text string"))
    drawn = [r.doc_id for r in got.where("rank is not null").collect()]
    assert len(drawn) == 50 and all(d % 5 == 0 for d in drawn)
    assert rows_of(got, *COLS) == brute(rows, target)
