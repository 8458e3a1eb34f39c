import hashlib
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import pandas as pd
import pytest
from edge_tables import rows_of

from cartlift.llm import conversations as C
from cartlift.llm.queries import QUERIES
from conftest import SF001

SCHEMA = "conv_id long, turn long, role string, text string"
COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WS = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if f == 0:
            continue
        text = "" if f == 1 else "".join(c for c in text if c not in ".!?") if f == 2 else text
        role = "user" if f == 4 else role
        out += [(conv, turn, role, text)] * (2 if f == 3 else 1)
    return out


def brute(rows, ids):
    """Every edit script by plain recursion over (turn, emitted so far modulo the pattern)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = []
    for conv in ids:
        own, seen, faults = sorted(convs[conv]), set(), []
        for _, _, role, text in own:
            body = [c for c in text if c not in WS]
            faults.append("blank" if not body else "duplicate" if (role, text) in seen
                          else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))

        @lru_cache(maxsize=None)
        def least(i, state, inserts=0):
            """(cost, audit, lines); state: "" s u a, what was written last."""
            options = []
            if i == len(own) and state in ("", "a"):
                options.append((0, "", ()))
            nxt = "a" if state == "u" else "u"
            name = {"a": "assistant", "u": "user"}[nxt]
            if inserts < 3:
                c, a, lines = least(i, nxt, inserts + 1)
                options.append((c + 2, "I" + a, (name + ":", *lines)))
            if i < len(own):
                role, text = own[i][2:]
                c, a, lines = least(i + 1, state)
                options.append((c + 3, "D" + a, lines))
                if faults[i] not in ("blank", "duplicate"):
                    more = faults[i] == "truncated"
                    c, a, lines = least(i + 1, nxt)
                    options.append((c + 2 + more, "R" + a, (f"{name}:{text}", *lines)))
                    own_initial = role[:1]
                    if own_initial == nxt or (own_initial == "s" and state == ""):
                        c, a, lines = least(i + 1, own_initial)
                        options.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
            return min(options, default=(10 ** 9, "", ()), key=lambda o: o[:2])

        cost, audit, lines = least(0, "")
        turns = [t for has, t, *_ in own if has]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
                    faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def made_up(seed, sizes):
    rng, rows = random.Random(seed), []
    for conv, n in enumerate(sizes):
        for t in range(n):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""])
            text = rng.choice(["Yes.", "no", "What?", "  ", None, "End !\n", f"t{t}.", f"t{t}", "é.", "x" * 50 + "."])
            rows.append((conv if conv else None, rng.choice([t, t, t, t + 1, None]), role, text))
    return rows


def readout(spark, rows, damage=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return C.repair_readout(C.damage_turns(df) if damage else df, df)


@pytest.mark.parametrize("bits,fan", [(10, 4096), (2, 2), (0, 2), (1, 3)])
def test_random_conversations(spark, monkeypatch, bits, fan):
    """Small blocks cut every conversation into chunks, small fans make several passes."""
    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    monkeypatch.setattr(C, "FAN", fan)
    monkeypatch.setattr(C.repair_conversations, "__defaults__", (*C.repair_conversations.__defaults__[:-1], fan))
    rows = made_up(bits, [12, 1, 2, 0, 3, 5, 8, 9, 7, 30])
    want = brute(rows, sorted({r[0] for r in rows}, key=repr))
    assert rows_of(readout(spark, rows), *COLS) == want


def test_damage_and_query(spark):
    d = pd.read_parquet(f"{SF001}/conversations.parquet")
    rows = list(zip(d.conv_id.tolist(), d.turn.tolist(), d.role, d.text))
    want = brute(damaged(rows), sorted(set(d.conv_id.tolist())))
    assert rows_of(QUERIES["op11_conversation_repair"](spark, SF001), *COLS) == want
    rows = made_up(77, [4] * 40)
    assert rows_of(readout(spark, rows, damage=True), *COLS) == brute(damaged(rows), sorted({r[0] for r in rows}, key=repr))


def test_conversation_that_loses_all_turns(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = readout(spark, [(conv, 0, "user", "Hi.")], damage=True).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_and_clashes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair_readout(empty, empty).count() == 0
    rows = made_up(5, [5, 4, 3])
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.selectExpr("*", "1 as conv", "2 as rank", "3 as at", "4 as block", "5 as fault", "6 as copy", "7 as _tie", "8 as n")
    assert rows_of(C.repair_readout(C.damage_turns(clash), clash), *COLS) == rows_of(readout(spark, rows, True), *COLS)


def test_repaired_turns_follow_the_pattern(spark):
    rows = made_up(9, [6] * 20)
    got = C.repaired_turns(C.repair_conversations(spark.createDataFrame(rows, SCHEMA))).orderBy("conv", "at", "place").collect()
    by = defaultdict(str)
    for r in got:
        by[r.conv] += r.role[0]
    assert by and all(s.removeprefix("s") == "ua" * (len(s) // 2) for s in by.values())


def test_chunks_converge():
    """After some ordinary turns vectors from all ends that can be reached agree
    up to a constant; a run of blank turns never lets them."""
    def spread(codes):
        m = C.chunk_costs(bytes(codes))
        columns = [[m[4 * s + e] for s in range(4)] for e in (C.AFTER_U, C.AFTER_A)]
        return len({tuple(c - min(col) for c in col) for col in columns})
    assert spread([3, 6] * 20) == 1 and spread([2] * 20) == 2


def test_chunk_costs_match_the_plain_product():
    rng = random.Random(4)
    for _ in range(200):
        codes = bytes(rng.randrange(12) for _ in range(rng.randrange(1, 9)))
        cut = rng.randrange(len(codes) + 1)
        whole = C.chunk_costs(codes)
        if 0 < cut < len(codes):
            assert C.stitch(C.chunk_costs(codes[:cut]), C.chunk_costs(codes[cut:])) == whole
        end = list(C.FINISH)
        assert tuple(C.before_chunk(whole, end)[:4]) == C.backward(codes, C.FINISH)[0]


def test_one_conversation_holds_most_turns(spark):
    """Only chunks of it meet in a task; blanks in long runs keep vectors apart."""
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant"]), " " if t % 3000 > 900 else f"turn {t}.") for t in range(6000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", "Fine.") for c in range(2, 60) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in C.repair_readout(df, df).collect()}
    codes = bytes(2 if t % 3000 > 900 else 3 * C.KINDS[r[2][0]] for t, r in enumerate(rows[:6000]))
    cost, audit, *_ = C.rewrite(codes, [r[2] for r in rows[:6000]], [r[3] for r in rows[:6000]], C.FINISH, C.START, True)
    assert (got[1].cost, got[1].audit) == (cost, audit) and len(got) == 59
