"""Conversation structure repair by a rank-convergence parallel Viterbi search.

A conversation's turns should read ``(s?(ua)+)?`` by role initials, without
blank, repeated or cut-off turns.  Each turn is kept (K, 0), given the role
user or assistant (R, 2) or deleted (D, 3; the only way for a blank or repeated
turn); empty user and assistant turns are inserted anywhere (I, 2); a cut-off
turn that isn't deleted costs 1 more.  Of all cheapest edits the one whose
letters are least in ASCII order is taken: walking forwards, the least letter
that keeps the backward cost optimal.

The search state is what was emitted last (nothing, s, u or a), so a *cost
vector* holds the cheapest cost to the end from each of four states, and only
differences inside it matter: vectors are kept with their least entry at 0, and
two that differ by a constant are equal.  They are few, so a step is a lookup.

All turns are put in one order (conversation, turn, role, text) by range
partitioning and cut into blocks of ``BLOCK`` turns.  A conversation inside a
block is solved there.  One that crosses a border is cut into *chunks*; nothing
ever holds more than a block of its turns:

1. each chunk runs backwards from speculative vectors, one for each state it
   could end in; a run stops where its vector has converged with the first
   run's (they differ by a constant only) and takes over the rest;
2. fix-up passes give every chunk its true end vector: chunks' results are
   stitched together, ``FAN`` at a time, up and down a tree, so the number of
   passes grows with the logarithm of the chunks even where (a long stretch of
   blank turns) vectors never converge;
3. chunks trace from all four start states at once; the same tree then tells
   each chunk its start state, and it writes its audit and repaired turns.

Repeated turns are found with one grouped minimum over (conversation, digest).

Defined cases: a null role or text is one blank; a null conversation id is a
conversation of its own; null turn numbers come first; turns with equal numbers
are taken in order of role and text; repeated rows are repeated turns; an empty
table gives empty results; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlift.llm.common import materialize
from cartlift.operators.ranking import global_rank

BLOCK_BITS = 10
FAN = 4096
BLANKS = " \t\n\x0b\x0c\r"

# the contract's costs and states (fixed values)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT_ROLE = ("user", "user", "assistant", "user")   # what may be written next, system apart
NEXT_STATE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
FINISH = (0, 4, 2, 0)                               # cost to end the conversation in a state
FINISH_EDITS = ("", "II", "I", "")
LEGAL_PAIRS = {"su", "ua", "au"}
KINDS = {"s": 0, "u": 1, "a": 2}
OTHER = 3
FINE, TRUNCATED, MUST_GO = range(3)                 # a turn's code is 3 * kind + fault
NEVER = 1 << 40
PIECE_FIELDS = ("at long, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, "
                "first_turn long, last_turn long, first_initial string, last_initial string, cost long, audit string, "
                "codes binary, roles array<string>, texts array<string>")


class Repaired(NamedTuple):
    """``conversations``: conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit.  ``pieces``: conv, at, whole, roles, texts: the repaired turns in
    order of ``at``; ``whole`` pieces are a conversation each."""
    conversations: DataFrame
    pieces: DataFrame


def kept_state(state: int, kind: int) -> int | None:
    """State after keeping a turn of this kind; None if the pattern forbids it."""
    if kind == 0:
        return AFTER_S if state == START else None
    if kind == 1:
        return AFTER_U if state != AFTER_U else None
    return AFTER_A if kind == 2 and state == AFTER_U else None


def _without_insert(state: int, code: int, after: tuple) -> int:
    kind, fault = divmod(code, 3)
    best = DELETE + after[state]
    if fault != MUST_GO:
        extra, keep = CUT_OFF * (fault == TRUNCATED), kept_state(state, kind)
        best = min(best, REROLE + extra + after[NEXT_STATE[state]])
        if keep is not None:
            best = min(best, KEEP + extra + after[keep])
    return best


def _cost(state: int, code: int, after: tuple) -> int:
    """Least cost from ``state`` before a turn; two inserts are the most that help."""
    once = NEXT_STATE[state]
    return min(_without_insert(state, code, after), INSERT + _without_insert(once, code, after),
               2 * INSERT + _without_insert(NEXT_STATE[once], code, after))


def _normal(costs: list[int]) -> tuple[tuple, int]:
    least = min(costs)
    return tuple(c - least if c < NEVER else NEVER for c in costs), least


@lru_cache(maxsize=None)  # normalised vectors are few: differences are bounded by the edit costs
def back(after: tuple, code: int) -> tuple[tuple, int]:
    """Vector before a turn from the vector after it, and the constant taken off."""
    return _normal([_cost(s, code, after) for s in range(4)])


@lru_cache(maxsize=None)
def choose(state: int, code: int, after: tuple) -> tuple[str, int]:
    """Least letters for a turn among the cheapest, and the state after it."""
    kind, fault = divmod(code, 3)
    extra, letters = CUT_OFF * (fault == TRUNCATED), ""
    while True:
        best = _cost(state, code, after)
        if DELETE + after[state] == best:
            return letters + "D", state
        if INSERT + _cost(NEXT_STATE[state], code, after) == best:
            letters, state = letters + "I", NEXT_STATE[state]
            continue
        keep = kept_state(state, kind)
        if keep is not None and KEEP + extra + after[keep] == best:
            return letters + "K", keep
        return letters + "R", NEXT_STATE[state]


def backward(codes: bytes, end: tuple) -> list[tuple]:
    """Vectors before each turn, and after the last one."""
    out = [end]
    for code in reversed(codes):
        out.append(back(out[-1], code)[0])
    out.reverse()
    return out


def chunk_costs(codes: bytes) -> list[int]:
    """Least cost from each state before the chunk to each state after it, by
    one run from each speculative end; runs stop where they have converged."""
    n = len(codes)
    base, spent = [None] * n + [None], [0] * (n + 1)
    result = [[NEVER] * 4 for _ in range(4)]
    for end in (AFTER_A, AFTER_U, AFTER_S, START):
        vector, total = tuple(0 if s == end else NEVER for s in range(4)), 0
        first = end == AFTER_A
        for i in range(n, -1, -1):
            if i < n:
                vector, add = back(vector, codes[i])
                total += add
            if first:
                base[i], spent[i] = vector, total
            elif base[i] == vector:  # only a constant apart from here on
                vector, total = base[0], total + spent[0] - spent[i]
                break
        for s in range(4):
            result[s][end] = total + vector[s] if vector[s] < NEVER else NEVER
    return [c for row in result for c in row]


def stitch(one: list[int], two: list[int]) -> list[int]:
    """Costs through two chunks (min-plus product)."""
    return [min(min(one[4 * s + m] + two[4 * m + e] for m in range(4)), NEVER) for s in range(4) for e in range(4)]


def before_chunk(costs: list[int], end: list[int]) -> list[int]:
    """Normalised vector before a chunk; the fifth entry marks the end of a conversation."""
    return [*_normal([min(costs[4 * s + e] + end[e] for e in range(4)) for s in range(4)])[0], 0]


def trace(codes: bytes, vectors: list[tuple], state: int) -> tuple[list[str], int]:
    """Letters of each turn and the last state, from a start state."""
    out = []
    for i, code in enumerate(codes):
        letters, state = choose(state, code, vectors[i + 1])
        out.append(letters)
    return out, state


def rewrite(codes: bytes, roles: list[str], texts: list[str], end: tuple, state: int, last: bool):
    """Cost, audit, and repaired roles and texts of a chunk."""
    edits, final = trace(codes, backward(codes, end), state)
    cost, new_roles, new_texts = 0, [], []
    for letters, code, role, text in zip(edits, codes, roles, texts):
        for letter in letters:
            if letter == "D":
                cost += DELETE
                continue
            if letter == "I":
                cost += INSERT
                new_roles.append(NEXT_ROLE[state])
                new_texts.append("")
                state = NEXT_STATE[state]
                continue
            cost += (REROLE if letter == "R" else KEEP) + CUT_OFF * (code % 3 == TRUNCATED)
            new_roles.append(NEXT_ROLE[state] if letter == "R" else role)
            new_texts.append(text)
            state = NEXT_STATE[state] if letter == "R" else kept_state(state, code // 3)
    if last:
        edits.append(FINISH_EDITS[final])
        for _ in FINISH_EDITS[final]:
            cost += INSERT
            new_roles.append(NEXT_ROLE[state])
            new_texts.append("")
            state = NEXT_STATE[state]
    return cost, "".join(edits), new_roles, new_texts


def _piece(conv, at: int, whole: bool, roles: list[str], texts: list[str], turns: list, first: list[bool]) -> dict:
    """Faults, structure and, for a whole conversation, its repair."""
    codes, n_blank, n_dup, n_cut = bytearray(), 0, 0, 0
    for role, text, new in zip(roles, texts, first):
        seen = text.rstrip(BLANKS)
        if not seen:
            fault, n_blank = MUST_GO, n_blank + 1
        elif not new:
            fault, n_dup = MUST_GO, n_dup + 1
        elif seen[-1] not in ".!?":
            fault, n_cut = TRUNCATED, n_cut + 1
        else:
            fault = FINE
        codes.append(3 * KINDS.get(role[:1], OTHER) + fault)
    initials = [r[:1] for r in roles]
    known = [t for t in turns if t is not None]
    out = {"conv": conv, "at": at, "whole": whole, "blank": n_blank, "duplicate": n_dup, "truncated": n_cut,
           "illegal": sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:])),
           "turns": len(set(known)), "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
           "first_initial": initials[0], "last_initial": initials[-1], "cost": None, "audit": None,
           "codes": None if whole else bytes(codes), "roles": roles, "texts": texts}
    if whole:
        out["cost"], out["audit"], out["roles"], out["texts"] = rewrite(bytes(codes), roles, texts, FINISH, START, True)
    return out


def _pieces(ranked: DataFrame, total: int, schema: T.StructType) -> DataFrame:
    """One row per conversation and block; only those at a block's border may be cut."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def solve(turns: pa.Table, firsts: pa.Table) -> pa.Table:
        t = turns.take(pc.sort_indices(turns.column("rank")))
        rank = t.column("rank").to_numpy()
        new = np.isin(rank, firsts.column("rank").to_numpy()).tolist()
        convs = t.column("conv").combine_chunks()
        same = convs.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(same)) + 1).tolist(), len(rank)]
        roles, texts, numbers = (t.column(c).to_pylist() for c in ("role", "text", "turn"))
        block, out = int(rank[0] - 1) >> BLOCK_BITS, []
        for s, e in zip(cuts, cuts[1:]):
            whole = (s > 0 or block == 0) and (e < len(rank) or int(rank[-1]) == total)
            out.append(_piece(convs[s].as_py(), 2 * block + (s > 0), whole, roles[s:e], texts[s:e], numbers[s:e], new[s:e]))
        return pa.Table.from_pylist(out, arrow)

    block = F.shiftright(F.col("rank") - 1, BLOCK_BITS).alias("block")
    digest = F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"))
    firsts = (ranked.groupBy("conv", F.unhex(digest).alias("digest")).agg(F.min("rank").alias("rank"))
              .select("rank", block))
    return (ranked.select("rank", "conv", "turn", "role", "text", block).groupBy("block")
            .cogroup(firsts.groupBy("block")).applyInArrow(solve, schema))


def _scan(nodes: DataFrame, start: list[int], join, step, backwards: bool, fan: int = FAN, span: int = FAN) -> DataFrame:
    """For every node (conv, at, x), ``at`` unique, the value that reaches it
    (at, seed), from ``start`` at its conversation's first (or last) node on.
    Nodes of one conversation and stretch of ``span`` numbers are taken
    together, ``fan`` at most; the stretches are the nodes of the next pass."""
    longs = pa.list_(pa.int64())

    def in_order(t: pa.Table) -> pa.Table:
        return t.take(pc.sort_indices(t, [("at", "descending" if backwards else "ascending")]))

    def walk(t: pa.Table) -> pa.Table:
        t = in_order(t)
        seeds, seed = [], (t.column("seed")[0].as_py() if "seed" in t.column_names else start)
        for x in t.column("x").to_pylist():
            seeds.append(seed)
            seed = step(x, seed)
        return pa.table({"at": t.column("at"), "seed": pa.array(seeds, longs)})

    def fold(t: pa.Table) -> pa.Table:
        xs = in_order(t).column("x").to_pylist()
        x = xs[0]
        for other in xs[1:]:
            x = join(other, x) if backwards else join(x, other)
        at = pa.array([pc.min(t.column("at")).as_py()], pa.int64())
        return pa.table({"conv": t.column("conv").slice(0, 1), "up": t.column("up").slice(0, 1), "at": at,
                         "x": pa.array([x], longs)})

    lo, hi = nodes.agg(F.min("at"), F.max("at")).first()
    if lo is None or lo // span == hi // span:
        return materialize(nodes.groupBy("conv").applyInArrow(walk, "at long, seed array<bigint>"), "seeds")
    grouped = nodes.select("conv", "at", "x", F.floor(F.col("at") / span).cast("long").alias("up"))
    schema = T.StructType([nodes.schema["conv"], *T.StructType.fromDDL("up long, at long, x array<bigint>").fields])
    parents = materialize(grouped.groupBy("conv", "up").applyInArrow(fold, schema), "parents")
    seeds = _scan(parents.select("conv", "at", "x"), start, join, step, backwards, fan, span * fan)
    above = parents.join(seeds, "at").select(F.col("conv").alias("own"), F.col("up").alias("over"), "seed")
    ready = grouped.join(above, F.col("conv").eqNullSafe(F.col("own")) & (F.col("up") == F.col("over")))
    return materialize(ready.select("conv", "up", "at", "x", "seed").groupBy("conv", "up")
                       .applyInArrow(walk, "at long, seed array<bigint>"), "seeds")


def _per_row(df: DataFrame, fn, schema) -> DataFrame:
    """``fn`` of each row (a dict), some rows of an Arrow batch at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 16):  # a row is a chunk of up to a block of turns
                yield pa.RecordBatch.from_pylist([fn(r) for r in b.slice(s, 16).to_pylist()], arrow)

    return df.mapInArrow(run, schema)


def _mended(cut: DataFrame, schema: T.StructType, fan: int) -> DataFrame:
    """Chunks of conversations that cross block borders, repaired."""
    codes = cut.select("conv", "at", "codes")
    conv = cut.schema["conv"]
    nodes = T.StructType([conv, *T.StructType.fromDDL("at long, x array<bigint>").fields])
    costs = materialize(_per_row(codes, lambda r: {"conv": r["conv"], "at": r["at"], "x": chunk_costs(r["codes"])}, nodes),
                        "chunk_costs")
    ends = _scan(costs, [*FINISH, 1], stitch, before_chunk, True, fan, fan).withColumnRenamed("seed", "end")

    def traces(r: dict) -> dict:
        vectors = backward(r["codes"], tuple(r["end"][:4]))
        return {"conv": r["conv"], "at": r["at"], "x": [trace(r["codes"], vectors, s)[1] for s in range(4)]}

    maps = materialize(_per_row(codes.join(ends, "at"), traces, nodes), "chunk_traces")
    starts = _scan(maps, [START], lambda one, two: [two[s] for s in one], lambda x, seed: [x[seed[0]]],
                   False, fan, fan).withColumnRenamed("seed", "start")

    def mend(r: dict) -> dict:
        end, last = r.pop("end"), False
        end, last = tuple(end[:4]), bool(end[4])
        r["cost"], r["audit"], r["roles"], r["texts"] = rewrite(
            r["codes"], r["roles"], r["texts"], end, r.pop("start")[0], last)
        r["codes"] = None
        return r

    return materialize(_per_row(cut.join(ends, "at").join(starts, "at"), mend, schema), "mended")


def _summed(mended: DataFrame) -> DataFrame:
    """Chunks' figures per conversation; borders between chunks count as inside."""
    rows = F.array_sort(F.collect_list(F.struct("at", "first_turn", "last_turn", "first_initial", "last_initial", "audit")))
    grouped = mended.groupBy("conv").agg(
        rows.alias("rows"), F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "cost")])
    n = F.size("rows")

    def borders(bad) -> Column:
        pairs = F.zip_with(F.slice("rows", 1, n - 1), F.slice("rows", 2, n - 1), bad)
        return F.size(F.filter(pairs, lambda x: x))

    illegal = borders(lambda a, b: ~F.concat(a["last_initial"], b["first_initial"]).isin(*LEGAL_PAIRS))
    again = borders(lambda a, b: F.coalesce(a["last_turn"] == b["first_turn"], F.lit(False)))
    return (grouped.withColumn("illegal", F.col("illegal") + illegal).withColumn("turns", F.col("turns") - again)
            .withColumn("audit", F.array_join(F.transform("rows", lambda r: r["audit"]), "")).drop("rows"))


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", fan: int = FAN) -> Repaired:
    """Cheapest repair of every conversation (see the module's text)."""
    blank = F.lit(" ")
    own = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                       F.coalesce(F.col(role_col).cast("string"), blank).alias("role"),
                       F.coalesce(F.col(text_col).cast("string"), blank).alias("text"))
    total = own.count()
    order = [(c, False) for c in ("conv", "turn", "role", "text")]
    ranked = global_rank(own, order, n=total)  # its rows are written, so ranks hold for every reader
    schema = T.StructType([T.StructField("conv", own.schema["conv"].dataType), *T.StructType.fromDDL(PIECE_FIELDS).fields])
    pieces = materialize(_pieces(ranked, total, schema), "pieces")
    whole = pieces.where("whole")
    mended = _mended(pieces.where("not whole"), schema, fan)
    figures = ["first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal", "turns", "cost", "audit"]
    found = whole.select("conv", *figures).unionByName(_summed(mended).select("conv", *figures))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    kept = ["conv", "at", "whole", "roles", "texts"]
    return Repaired(found.select("conv", gaps, *figures[2:6], "cost", "audit"),
                    whole.select(kept).unionByName(mended.select(kept)))


def repaired_turns(repaired: Repaired) -> DataFrame:
    """The repaired turns, one row each: conv, at and place (their order), role, text."""
    both = F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text"))
    return repaired.pieces.select("conv", "at", F.posexplode(both).alias("place", "turn")).select(
        "conv", "at", "place", "turn.role", "turn.text")


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation SHA-256 of its ``role:text`` lines, joined by newlines.

    Whole pieces are hashed where they are.  A SHA-256 can only be taken in
    order, so a conversation of several chunks streams through one task, chunk
    by chunk, holding nothing but the hash; that holds for the digest only.
    """
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    ready = pieces.select("conv", "at", "whole", (F.size("roles") > 0).alias("some"), lines.cast("binary").alias("lines"))
    conv = pieces.schema["conv"]
    from pyspark.sql.pandas.types import to_arrow_type
    conv_arrow = to_arrow_type(conv.dataType)

    def run(batches):
        import hashlib
        current, state, any_line, done = None, None, False, []
        for b in batches:
            for i in range(b.num_rows):
                owner = (b.column(0)[i].as_py(),)
                if owner != current:
                    if current is not None:
                        done.append((current[0], state.hexdigest()))
                    current, state, any_line = owner, hashlib.sha256(), False
                if b.column(1)[i].as_py():
                    if any_line:
                        state.update(b"\n")
                    state.update(b.column(2)[i].as_buffer())
                    any_line = True
        if current is not None:
            done.append((current[0], state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], conv_arrow), pa.array([d[1] for d in done], pa.string())],
                                         names=["conv", "sha256"])

    several = (ready.where("not whole").repartition("conv").sortWithinPartitions("conv", "at")
               .select("conv", "some", "lines").mapInArrow(run, T.StructType([conv, T.StructField("sha256", T.StringType())])))
    return ready.where("whole").select("conv", F.sha2("lines", 256).alias("sha256")).unionByName(several)


def damage_turns(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, by CRC-32 of ``conv_id:turn`` modulo 20: 0
    drops a turn, 1 empties its text, 2 takes away ``.!?``, 3 repeats it, 4
    gives it to the user.  Nulls (ids in the key, roles and texts) are one blank."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), blank))
    text = F.coalesce(F.col("text"), blank)
    hit = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), text.alias("text"),
                       (F.crc32(key.cast("binary")) % 20).alias("fault")).where("fault <> 0")
    hit = hit.withColumn("text", F.when(F.col("fault") == 1, "").when(
        F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    hit = hit.withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.withColumn("copy", F.explode(copies)).drop("copy", "fault")


def repair_readout(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per conversation of ``conversations`` (conv_id) the figures of the
    repair of ``turns`` and the digest of the repaired turns; a conversation
    without turns has zeros, an empty audit and the digest of nothing."""
    repaired = repair_conversations(turns)
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    sha = digests(repaired.pieces)
    found = repaired.conversations.select("conv", F.lit(1).alias("n"), *longs, "audit", F.lit(None).cast("string").alias("sha256"))
    hashed = sha.select("conv", F.lit(1).alias("n"), *[F.lit(None).cast("long").alias(c) for c in longs],
                        F.lit(None).cast("string").alias("audit"), "sha256")
    nothing = conversations.select(F.col("conv_id").alias("conv")).distinct().select(
        "conv", F.lit(0).alias("n"), *[F.lit(0).cast("long").alias(c) for c in longs], F.lit("").alias("audit"),
        F.sha2(F.lit("").cast("binary"), 256).alias("sha256"))
    # three rows a conversation at most; of those with a value the one of the repair counts
    def best(c: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("n") == 1, F.col(c))), F.max(c)).alias(c)

    both = found.unionByName(hashed).unionByName(nothing).groupBy("conv").agg(*[best(c) for c in (*longs, "audit", "sha256")])
    return both.select(F.col("conv").alias("conv_id"), *longs, "audit", F.col("sha256").alias("repaired_sha256"))
