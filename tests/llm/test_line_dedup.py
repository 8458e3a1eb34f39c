import hashlib
from collections import defaultdict

import pytest
from edge_tables import ROWS, documents, edge_docs, empty_docs, rows_of, with_clashes

from cartlift.llm.common import ASCII_FOLD
from cartlift.llm.line_dedup import BLANKS, line_dedup
from cartlift.llm.queries import QUERIES
from conftest import SF001

COLS = ["doc_id", "n_lines", "n_dropped", "kept_text"]


def brute(rows, min_chars=20, min_docs=3, keep="largest"):
    """Rows as documents, in reading order."""
    holders = defaultdict(list)
    cut = [(t or "").split("\n") for _, t in rows]

    def key(line):
        return line.strip(BLANKS).translate(ASCII_FOLD)
    for i, lines in enumerate(cut):
        for k in {key(line) for line in lines if len(key(line)) >= min_chars}:
            holders[k].append((rows[i][0] is not None, rows[i][0] or 0, i))
    best = {k: (max(v)[2] if keep == "largest" else
                min((not has, d, i) for has, d, i in v)[2] if keep == "smallest" else None)
            for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, lines in enumerate(cut):
        left = [line for line in lines if best.get(key(line), i) == i]
        out.append((rows[i][0], len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


SHARED = [
    (1, "  All Rights Reserved, the owners 1999\r\nbody of one\nAll rights reserved, the owners 1999\t"),
    (2, "all rights reserved, the owners 1999\n\nshort\nshort"),
    (3, "short\nbody of three\nALL RIGHTS RESERVED, THE OWNERS 1999"),
    (4, "short\nexactly twenty chars"),
    (5, "EXACTLY twenty chars\n"),
    (None, "exactly twenty chars\n\x0b all rights reserved, the owners 1999\x0c"),
    (7, "ÀLL RIGHTS RESERVED, THE OWNERS 1999\nàll rights reserved, the owners 1999"),
    (8, "nineteen chars long\nnineteen chars long"), (9, "nineteen chars long"), (10, "nineteen chars long"),
]


@pytest.mark.parametrize("keep", ["largest", "smallest", "none"])
def test_shared_lines(spark, keep):
    df = spark.createDataFrame(SHARED, "doc_id long, text string").coalesce(1)
    assert rows_of(line_dedup(df, keep=keep), *COLS) == brute(SHARED, keep=keep)


def test_edges_and_clashes(spark):
    rows = [(r[0], r[1]) for r in ROWS]
    assert rows_of(line_dedup(edge_docs(spark), min_chars=2, min_docs=4), *COLS) == brute(rows, 2, 4)
    assert rows_of(line_dedup(with_clashes(edge_docs(spark)), min_docs=2), *COLS) == rows_of(
        line_dedup(edge_docs(spark), min_docs=2), *COLS)
    clash = edge_docs(spark).selectExpr("*", "1 as row", "2 as keys", "3 as gone", "4 as lines", "5 as kept_text", "6 as at")
    assert line_dedup(clash).columns == COLS
    assert line_dedup(empty_docs(spark)).count() == 0


def test_repeated_rows_are_documents(spark):
    """A line of three equal rows stays once."""
    df = spark.createDataFrame([(1, "a line of more than twenty characters")] * 3, "doc_id long, text string")
    assert sorted(r.n_dropped for r in line_dedup(df).collect()) == [0, 1, 1]


def test_very_long_text(spark):
    text = "\n".join(f"common line with number {i % 500:06d}" for i in range(60_000))
    rows = [(1, text), (2, text[:5000]), (3, text)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got, *COLS) == brute(rows)


def test_query_matches_brute_force(spark):
    d = documents(SF001)
    want = [(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute(list(zip(d.doc_id.tolist(), d.text)))]
    got = QUERIES["op13_line_dedup"](spark, SF001)
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)


def test_lines_are_cut_once_a_row(spark):
    """The array of lines is computed in a projection of its own, not inside the lambda."""
    plan = line_dedup(edge_docs(spark))._jdf.queryExecution().optimizedPlan().toString()
    kept = next(line for line in plan.splitlines() if "kept_text" in line)
    assert "split(" not in kept
