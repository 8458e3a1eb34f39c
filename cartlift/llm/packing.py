"""Best-fit packing of documents into sequences by bin completion.

Every document becomes pieces of at most ``capacity`` tokens.  How pieces
combine depends on their lengths alone, and there are at most ``capacity``
different lengths, whatever the corpus size.  So the search runs on the
histogram of lengths (the only thing that reaches the driver), and its plan is
a short list of *patterns*: a filling of one sequence and how often it is used.

Planning is bin completion by branch and bound: take the largest length left,
enumerate the undominated fillings of the rest of its sequence by their waste
(bit sets of reachable sums keep that enumeration free of dead ends), use one
as often as pieces last, or less often, and go on; backtrack when the waste so
far leaves no better solution.  The incumbent is the best-fit solution first,
then every better one.  Paths are tried in the order of how far they depart
from the least waste, without an end, so the search is complete: it stops at
the lower bound, when no path is left, or after ``steps`` steps, a bound on the
driver's work that does not grow with the corpus.  The plan tells sequences,
lower bound and whether the optimum is proven; ``pack`` logs all three.

Pieces are then numbered among those of equal length without any sort or
shuffle by length alone: each written partition numbers its own, the counts
per (partition, length) are prefix-summed, and number and plan give sequence
and offset.  A length that a third of all pieces share is spread over the
partitions like any other.

Defined cases: a null text is empty and packs as its end token alone; equal
ids are packed row by row; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import json
import logging
import zlib
from bisect import bisect_left, bisect_right, insort
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlift.llm.bpe import byte_values
from cartlift.llm.common import materialize, row_chunks

LOG = logging.getLogger(__name__)

#: Word pattern of the byte-level vocabulary (a fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_level_encoder(content: str) -> tiktoken.Encoding:
    """Encoder with the ids of a byte-level tokenizer file: its ids follow the
    merge order, so they are the ranks; special tokens are recognised."""
    spec = json.loads(content)
    byte = byte_values()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens; only the first may be short."""
    k = max(1, -(-n // capacity))
    return [n - (k - 1) * capacity, *[capacity] * (k - 1)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of each document, numbered among those of equal length in their
    partition (``part``, ``place``).  ``with_ids`` adds the token ids."""
    with open(tokenizer_path, encoding="utf-8") as fh:
        shared = docs.sparkSession.sparkContext.broadcast(fh.read())
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField("part", T.IntegerType()), T.StructField(id_col, id_type),
              T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
              T.StructField("place", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    names = [f.name for f in fields]

    def run(batches):
        enc = byte_level_encoder(shared.value)
        part = TaskContext.get().partitionId()
        placed = np.zeros(capacity + 1, dtype=np.int64)
        for rows in row_chunks(batches, [id_col, text_col]):
            out = []
            for doc_id, text in rows:
                ids = enc.encode(text, allowed_special="all") if text else []
                ids.append(end_id)
                data = np.array(ids, dtype="<u4")
                at = 0
                for k, n in enumerate(cut(len(data), capacity)):
                    own = data[at:at + n]
                    out.append((part, doc_id, k, at, n, zlib.crc32(own.tobytes()), int(placed[n]),
                                *([own.tolist()] if with_ids else [])))
                    placed[n] += 1
                    at += n
            yield pa.RecordBatch.from_pandas(_frame(out, names), schema=schema, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(T.StructType(fields))
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def _frame(rows: list[tuple], names: list[str]):
    import pandas as pd
    return pd.DataFrame(rows, columns=names)


class Stock:
    """Lengths still to be packed, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {l: n for l, n in counts.items() if n > 0}
        self.sorted = sorted(self.counts)

    def largest(self, room: int) -> int:
        """Largest length in stock of at most ``room`` (0: none)."""
        i = bisect_right(self.sorted, room)
        return self.sorted[i - 1] if i else 0

    def take(self, pattern: dict[int, int], times: int) -> None:
        for l, k in pattern.items():
            self.counts[l] -= k * times
            if not self.counts[l]:
                del self.counts[l]
                del self.sorted[bisect_right(self.sorted, l) - 1]

    def give_back(self, pattern: dict[int, int], times: int) -> None:
        for l, k in pattern.items():
            if l not in self.counts:
                insort(self.sorted, l)
            self.counts[l] = self.counts.get(l, 0) + k * times

    def lasts(self, pattern: dict[int, int]) -> int:
        """How often the pattern can be taken."""
        return min(self.counts[l] // k for l, k in pattern.items())


class Spent(Exception):
    """The search has used its steps up."""


class Budget:
    def __init__(self, steps: int):
        self.left = steps

    def spend(self, steps: int = 1) -> None:
        self.left -= steps
        if self.left < 0:
            raise Spent


def reachable(lengths: list[int], most: list[int], room: int) -> list[int]:
    """Bit sets of the sums up to ``room`` that the first 0, 1, 2, ... lengths reach."""
    keep = (1 << (room + 1)) - 1
    sums = [1]
    for l, n in zip(lengths, most):
        bits, k = sums[-1], 1
        while n > 0:  # multiplicities 1, 2, 4, ... and the rest
            k = min(k, n)
            bits |= bits << (k * l) & keep
            n -= k
            k *= 2
        sums.append(bits)
    return sums


def fillings(stock: Stock, first: int, capacity: int, most_waste: int, want: int,
             budget: Budget) -> list[tuple[int, dict[int, int]]]:
    """The ``want`` best undominated fillings around one piece of length ``first``: (waste, pattern).

    They come by waste, then with larger pieces first.  A filling is dominated,
    and not listed, when a piece left in stock fits its free room, or could take
    the place of one smaller piece or of two pieces without passing the capacity:
    what it replaces then fits wherever that piece would have gone.
    """
    room = capacity - first
    lengths = stock.sorted[:bisect_right(stock.sorted, room)]
    own = [stock.counts[l] - (l == first) for l in lengths]
    lengths, own = [l for l, n in zip(lengths, own) if n], [n for n in own if n]
    budget.spend(50 + len(lengths))  # a step is one test, roughly
    sums = reachable(lengths, [min(n, room // l) for l, n in zip(lengths, own)], room)
    used = [0] * len(lengths)
    found: list[tuple[int, dict[int, int]]] = []

    def spare(low: int, high: int) -> bool:
        """Whether a length of low..high is in stock and unused."""
        at = bisect_left(lengths, low)
        budget.spend()
        while at < len(lengths) and lengths[at] <= high:
            if used[at] < own[at]:
                return True
            budget.spend()
            at += 1
        return False

    def complete(goal: int, waste: int) -> None:
        """All undominated choices of exactly ``goal`` tokens, by an explicit stack."""
        chosen: list[int] = []                      # positions in ``lengths``, never rising
        nxt, left = len(lengths) - 1, goal
        while True:
            if left == 0:
                if not lengths or not spare(1, waste):
                    pattern = {first: 1}
                    for at in chosen:
                        pattern[lengths[at]] = pattern.get(lengths[at], 0) + 1
                    found.append((waste, pattern))
                    if len(found) >= want:
                        return
                nxt = -1
            while nxt >= 0:
                budget.spend()
                nxt = min(nxt, bisect_right(lengths, left) - 1)
                if nxt < 0 or not sums[nxt + 1] >> left & 1:
                    nxt = -1                        # smaller lengths reach no more than these
                    break
                l = lengths[nxt]
                if used[nxt] < own[nxt] and sums[nxt + 1] >> (left - l) & 1 and not spare(l + 1, l + waste) \
                        and not any(spare(l + lengths[o], l + lengths[o] + waste) for o in set(chosen)):
                    break
                nxt -= 1
            if nxt >= 0:
                chosen.append(nxt)
                used[nxt] += 1
                left -= lengths[nxt]
                continue
            if not chosen:
                return
            last = chosen.pop()
            used[last] -= 1
            left += lengths[last]
            nxt = last - 1

    for waste in range(min(room, most_waste) + 1):
        if sums[-1] >> (room - waste) & 1:
            complete(room - waste, waste)
            used = [0] * len(lengths)
            if len(found) >= want:
                break
    return found


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by the large pieces
    with the volume that can't join them."""
    total = sum(l * n for l, n in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    for cutoff in (l for l in lengths if l <= capacity // 2):
        large = sum(n for l, n in counts.items() if l > capacity - cutoff)
        middle = {l: n for l, n in counts.items() if capacity // 2 < l <= capacity - cutoff}
        small = sum(l * n for l, n in counts.items() if cutoff <= l <= capacity // 2)
        free = sum((capacity - l) * n for l, n in middle.items())
        best = max(best, large + sum(middle.values()) + max(0, -(-(small - free) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """The best-fit solution, the search's first incumbent: each sequence takes
    the largest pieces that fit, and is repeated as often as they last."""
    stock, out = Stock(counts), []
    while stock.sorted:
        pattern: dict[int, int] = {}
        left, nxt = capacity, stock.sorted[-1]
        while nxt:
            pattern[nxt] = min(stock.counts[nxt], left // nxt)
            left -= pattern[nxt] * nxt
            nxt = stock.largest(min(left, nxt - 1))
        times = stock.lasts(pattern)
        stock.take(pattern, times)
        out.append((times, pattern))
    return out


class Plan(NamedTuple):
    """Patterns (times, {length: pieces}), their sequences, the lower bound, and
    whether the search has proven that no packing needs fewer."""
    patterns: list[tuple[int, dict[int, int]]]
    sequences: int
    bound: int
    proven: bool


def _options(stock: Stock, capacity: int, waste_left: int, slack: int, budget: Budget) -> tuple[list, bool]:
    """Up to ``slack`` + 1 ways to go on, (waste, times, pattern), and whether more exist.

    Every filling comes as often as it lasts first, then all again half as
    often and so on down to once, so that single use is among the ways too."""
    found = fillings(stock, stock.sorted[-1], capacity, waste_left, slack + 2, budget)
    ways, times = [], [stock.lasts(p) for _, p in found]
    while any(times):
        ways += [(w, t, p) for t, (w, p) in zip(times, found) if t and w * t <= waste_left]
        times = [t // 2 for t in times]
    return ways[:slack + 1], len(ways) > slack + 1 or len(found) > slack + 1


def improve(counts: dict[int, int], capacity: int, slack: int, limit: int,
            budget: Budget) -> tuple[list[tuple[int, dict[int, int]]] | None, bool]:
    """A solution that wastes at most ``limit`` tokens, or None, and whether
    ways were left out.  Depth first with backtracking; along one path the ranks
    of the ways taken add up to ``slack`` at most (limited discrepancy)."""
    stock, cut_off = Stock(counts), False
    ways, more = _options(stock, capacity, limit, slack, budget)
    cut_off |= more
    frames = [(iter(enumerate(ways)), slack)]
    path: list[tuple[int, int, dict[int, int]]] = []        # one less than frames
    waste = 0
    while frames:
        step = next(frames[-1][0], None)
        if step is None:
            frames.pop()
            if path:
                left, times, pattern = path.pop()
                stock.give_back(pattern, times)
                waste -= left * times
            continue
        rank, (left, times, pattern) = step
        stock.take(pattern, times)
        waste += left * times
        path.append((left, times, pattern))
        if not stock.sorted:
            return [(t, p) for _, t, p in path], cut_off
        rest = frames[-1][1] - rank
        ways, more = _options(stock, capacity, limit - waste, rest, budget)
        cut_off |= more
        frames.append((iter(enumerate(ways)), rest))
    return None, cut_off


def bin_completion(counts: dict[int, int], capacity: int, steps: int = 10_000_000) -> Plan:
    """Patterns that pack all pieces into as few sequences as the search finds in ``steps`` steps."""
    full = counts.get(capacity, 0)
    rest = {l: n for l, n in counts.items() if 0 < l < capacity and n > 0}
    out = [(full, {capacity: 1})] if full else []
    if not rest:
        return Plan(out, full, full, True)
    total = sum(l * n for l, n in rest.items())
    bound = lower_bound(rest, capacity)
    best = best_fit(rest, capacity)
    bins = sum(t for t, _ in best)
    budget, slack, proven = Budget(steps), 0, bins == bound
    while not proven:
        try:
            found, cut_off = improve(rest, capacity, slack, (bins - 1) * capacity - total, budget)
        except Spent:
            break
        if found is not None:
            best, bins = found, sum(t for t, _ in found)
            proven = bins == bound
        else:
            proven = not cut_off
            slack = 2 * slack + 1
    return Plan(out + best, full + bins, full + bound, proven)


def allocation(plan: list[tuple[int, dict[int, int]]], capacity: int) -> dict[int, np.ndarray]:
    """Per length: rows (first number, first sequence, pieces a sequence, offset), by first number."""
    taken = [0] * (capacity + 1)
    rows: dict[int, list] = {}
    sequence = 0
    for times, pattern in plan:
        offset = 0
        for l in sorted(pattern, reverse=True):
            k = pattern[l]
            rows.setdefault(l, []).append((taken[l], sequence, k, offset))
            taken[l] += k * times
            offset += k * l
        sequence += times
    return {l: np.array(r, dtype=np.int64) for l, r in rows.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False, steps: int = 10_000_000) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = docs.sparkSession
    # written once: partition and place must be the same for every later reader
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg((F.max("place") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = bin_completion(histogram, capacity, steps)
    LOG.info("%d sequences, lower bound %d, optimum %s", found.sequences, found.bound,
             "proven" if found.proven else "not proven")
    plan = spark.sparkContext.broadcast(allocation(found.patterns, capacity))

    numbered = pieces.join(offsets, ["part", "length"]).withColumn("number", F.col("place") + F.col("before"))
    kept = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = T.StructType([*[pieces.schema[c] for c in kept], T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def place(batches):
        table = plan.value
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            number = b.column(b.schema.get_field_index("number")).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for l in np.unique(length):
                at = np.flatnonzero(length == l)
                rows = table[int(l)]
                own = rows[np.searchsorted(rows[:, 0], number[at], side="right") - 1]
                i = number[at] - own[:, 0]
                sequence[at] = own[:, 1] + i // own[:, 2]
                offset[at] = own[:, 3] + i % own[:, 2] * l
            yield pa.RecordBatch.from_arrays(
                [*[b.column(b.schema.get_field_index(c)) for c in kept], pa.array(sequence), pa.array(offset)],
                names=[f.name for f in schema.fields])

    return numbered.select(*kept, "number").mapInArrow(place, schema)
