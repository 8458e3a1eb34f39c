"""Language identification by cross-parsing entropy.

For every language a suffix automaton of a bounded sample of labelled text is
built; it accepts exactly the substrings of that sample.  A document is parsed
greedily against each automaton into longest matches (phrases).  The language
that needs the fewest phrases, normalised by the logarithm of its sample's
length, wins: text of a language decomposes into long pieces already seen in it.

Texts are folded to lower-case letters, anything else being one separator, and
read as UTF-8 bytes, so that no alphabet has to be chosen.
Long texts are parsed in lanes of ``LANE`` symbols, all lanes of a batch one
symbol per step, so a batch costs a fixed number of array operations per
symbol position; whole texts are read and lane borders only add phrases, for
all languages alike.

The sample is bounded by documented parameters: pieces of at most
``docs_per_lang`` documents (lowest hash of the id), ``chars_per_lang``
characters for each language, taken from anywhere in a text.  A language's
automaton has at most twice as many states as its sample has bytes, and a
column for each byte value that occurs there.

Defined cases: null text or text without a letter gives ``und`` with score 0;
without any labelled row every text is ``und``; ``und`` may be a learnt label
too, so only the flag of ``identify`` tells whether a text has a letter; ties go to the first language
in alphabetical order; equal ids are scored row by row; other columns are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlift.llm.common import materialize, replacing, row_chunks

LANE = 256
UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")


def suffix_automaton(codes: list[int], width: int) -> np.ndarray:
    """Dense transition table (states x width, -1: none) of the automaton
    that accepts every substring of ``codes``."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(nxt), width), -1, dtype=np.int32)
    for s, row in enumerate(nxt):
        for c, t in row.items():
            table[s, c] = t
    return table


@dataclass
class Automaton:
    """Transitions of one language's sample over the byte values that occur in it."""

    code: np.ndarray    # of each byte value; 0 is the padding of a lane
    table: np.ndarray   # states x codes, -1: none
    symbols: int        # length of the sample
    pad: int

    @classmethod
    def of(cls, sample: bytes) -> Automaton:
        seen = sorted(set(sample))
        code = np.full(256, len(seen), dtype=np.int64)      # a byte that the sample lacks
        code[seen] = np.arange(len(seen))
        code[0] = len(seen) + 1
        return cls(code, suffix_automaton(code[list(sample)].tolist(), len(seen) + 2), len(sample), len(seen) + 1)


@dataclass
class LanguageModel:
    """One automaton for each language."""

    tables: dict[str, Automaton] = field(default_factory=dict)


def symbols_of(text: str) -> bytes:
    """UTF-8 of the lower-case letters, any run of other characters as one space."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def phrase_counts(lanes: np.ndarray, table: np.ndarray, pad: int) -> np.ndarray:
    """Greedy longest-match phrases of each lane (rows: positions, columns: lanes).
    A symbol that the sample lacks is a phrase of its own; padding ends a lane."""
    width = table.shape[1]
    flat = table.ravel()
    root = np.maximum(table[0], 0)
    unseen = (table[0] < 0) & (np.arange(width) != pad)
    state = np.zeros(lanes.shape[1], dtype=np.int64)
    count = np.zeros(lanes.shape[1], dtype=np.int64)
    for codes in lanes:
        nxt = flat[state * width + codes]
        miss = nxt < 0
        count += (miss & (state != 0)) + unseen[codes].astype(np.int64)
        state = np.where(miss, root[codes], nxt).astype(np.int64)
    return count + (state != 0)  # the phrase still open


def classify(texts: list[str | None], model: LanguageModel) -> list[tuple[str, float, bool]]:
    """(language, score, has a letter) of each text.

    A language's cost is phrases x log2(sample length), the bits that name them
    by their places in the sample; score = runner-up's cost / both costs.  With
    a single language the runner-up is the text itself at eight bits a byte."""
    out = [(UNDETERMINED, 0.0, False)] * len(texts)
    some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    for i in some:
        out[i] = (UNDETERMINED, 0.0, True)
    langs = sorted(model.tables)
    if not some or not langs:
        return out
    parts = [np.frombuffer(symbols_of(texts[i]), dtype=np.uint8) for i in some]
    sizes = np.array([len(p) for p in parts])
    n_lanes = -(-sizes // LANE)
    flat = np.zeros(n_lanes.sum() * LANE, dtype=np.uint8)
    at = 0
    for p, n in zip(parts, n_lanes.tolist()):
        flat[at:at + len(p)] = p
        at += n * LANE
    lanes = np.ascontiguousarray(flat.reshape(-1, LANE).T)
    first = np.concatenate([[0], np.cumsum(n_lanes)[:-1]])
    cost = np.stack([np.add.reduceat(phrase_counts(m.code[lanes], m.table, m.pad), first) * np.log2(m.symbols + 1)
                     for m in (model.tables[l] for l in langs)])
    order = np.argsort(cost, axis=0, kind="stable")
    best = np.take_along_axis(cost, order[:1], 0)[0]
    second = np.take_along_axis(cost, order[1:2], 0)[0] if len(langs) > 1 else 8.0 * sizes
    for j, i in enumerate(some):
        out[i] = (langs[order[0, j]], float(second[j] / (second[j] + best[j])), True)
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        docs_per_lang: int = 200, chars_per_lang: int = 40_000, piece: int = 400) -> LanguageModel:
    """Build the automata from the labelled rows of ``docs`` (rows to learn from only).

    Each language's sample are ``chars_per_lang // piece`` pieces of ``piece``
    characters from anywhere in its documents: one of each document first,
    then second ones and so on, in the order of a hash."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", "lang"), "id")
    chosen = (labelled.select("id", "lang").distinct().withColumn("place", F.row_number().over(order))
              .where(F.col("place") <= docs_per_lang).select(F.col("id").alias("own"), F.col("lang").alias("of"), "place"))
    # at most docs_per_lang ids for each language, so the broadcast is bounded; of rows that share an id one counts
    whole = (labelled.join(F.broadcast(chosen), F.col("id").eqNullSafe(F.col("own")) & (F.col("lang") == F.col("of")))
             .groupBy("lang", "place").agg(F.min("text").alias("text")))
    whole = materialize(whole, "language_texts")
    starts = whole.select("lang", "place", F.explode(F.sequence(
        F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / piece).cast("int"))).alias("at"))
    in_doc = Window.partitionBy("lang", "place").orderBy(F.xxhash64("place", "at"), "at")
    in_lang = Window.partitionBy("lang").orderBy("turn", "place")
    picked = (starts.withColumn("turn", F.row_number().over(in_doc)).withColumn("nth", F.row_number().over(in_lang))
              .where(F.col("nth") <= max(1, chars_per_lang // piece)))
    sample = (whole.join(picked, ["lang", "place"])
              .select("lang", "nth", F.substring("text", F.col("at") * piece + 1, F.lit(piece)).alias("text")).collect())
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in sample:
        parts.setdefault(r["lang"], []).append((r["nth"], b" " + symbols_of(r["text"])))
    return LanguageModel({l: Automaton.of(b"".join(p for _, p in sorted(own))) for l, own in sorted(parts.items())})


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred",
             score_col: str = "score", letter_col: str | None = None) -> DataFrame:
    """All rows and columns, with the predicted language and its score appended,
    and as ``letter_col``, if named, whether the text has a letter; columns that
    had these names are replaced."""
    docs = replacing(docs, pred_col, score_col, letter_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()),
                           T.StructField(score_col, T.DoubleType()),
                           *([T.StructField(letter_col, T.BooleanType())] if letter_col else [])])

    def run(batches):
        own = shared.value
        for b in batches:
            found: list[tuple[str, float, bool]] = []
            for rows in row_chunks([b], [text_col], 2_000_000):
                found += classify([r[0] for r in rows], own)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()),
                 *([pa.array([f[2] for f in found], pa.bool_())] if letter_col else [])],
                names=schema.names)

    return docs.mapInArrow(run, schema)
