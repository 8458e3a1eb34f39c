"""Substring deduplication by relative Lempel-Ziv factors.

A document is factored greedily, left to right, against an index of the whole
corpus: at each word the longest stretch that also occurs elsewhere is the next
factor.  A factor counts if it has at least ``window`` words, and a stretch of
that length occurs elsewhere exactly if each of its ``window``-word sequences
does.  The reference is therefore indexed by word windows, cut into blocks by
hash: every window of every document lies in exactly one block, and each
document is looked up in all blocks that could hold one of its windows.  A
factor ends where a window is not found.  Windows that begin in one factor and
end in the next are looked up like all others, so what lies across a factor
boundary is checked too: the result is exact, not what a greedy parse happens
to cover.

Most windows are unique, so a first round sends only *anchors*: the smallest
hash of the ``gram``-word sequences in a window.  Equal windows have equal
anchors, neighbouring windows mostly share theirs (about two anchors for each
``window - gram`` words), and windows whose anchor occurs once are done.

Documents travel in *bundles* (a few megabytes of compressed text).  A bundle
sends each distinct hash once to a block and learns one bit for it, so a
passage that a third of all documents hold costs one entry for each bundle,
whatever its number of copies.  Blocks are sized by the corpus' word count.

Windows are compared by 96 hash bits.  Defined cases: null or empty texts have
no words; texts shorter than a window lose nothing; repeated rows are
duplicates of each other; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import pickle
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlift.llm.common import WordHashes, materialize, mix64, row_chunks, words_of

BUNDLE_CHARS = 4_000_000
BLOCK_BYTES = 4_000_000
MIN_BLOCKS = 64
BASE1, BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
GRAM = 8


class Sequences:
    """Hashes of word sequences of one array of words, by prefix sums modulo 2**64."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            power = np.full(n, base, np.uint64)
            back = np.full(n, inverse, np.uint64)
            if n:
                power[0] = back[0] = 1
            self.back = np.cumprod(back, dtype=np.uint64)
            self.sums = np.concatenate([np.zeros(1, np.uint64),
                                        np.cumsum(hashes * np.cumprod(power, dtype=np.uint64), dtype=np.uint64)])

    def of(self, length: int) -> np.ndarray:
        """Hash of the sequence of ``length`` words at each position."""
        if len(self.sums) <= length:
            return np.zeros(0, np.uint64)
        return mix64((self.sums[length:] - self.sums[:-length]) * self.back[:len(self.sums) - length])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class Windows:
    """Words, windows and anchors of the documents of one bundle."""

    def __init__(self, texts: list[str | None], window: int, hashes: WordHashes):
        self.docs = [words_of(t) for t in texts]
        self.window = window
        lengths = np.array([len(d) for d in self.docs], dtype=np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        words = [w for d in self.docs for w in d]
        self.n = len(words)
        h = hashes.array(words)
        gram = min(GRAM, window)
        one = Sequences(h, BASE1)
        count = max(0, self.n - window + 1)
        last = np.repeat(self.ends, lengths)[:count]            # end of the document at each word
        self.at = np.flatnonzero(np.arange(count) + window <= last)
        self.grams = one.of(gram)
        self.anchor = sliding_min(self.grams, window - gram + 1)[:count][self.at]
        self.hash1 = one.of(window)[self.at]
        self.hash2 = (Sequences(mix64(h ^ np.uint64(BASE2)), BASE2).of(window)[self.at] >> np.uint64(32)).astype(np.uint32)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, sorted, and whether the sequence of each stands at
        several places here (also overlapping ones, as in periodic text)."""
        values = np.unique(self.anchor)
        if not len(values):
            return values, np.zeros(0, bool)
        at = np.minimum(np.searchsorted(values, self.grams), len(values) - 1)
        return values, np.bincount(at[values[at] == self.grams], minlength=len(values)) > 1

    def windows(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows with a repeated anchor (flags as of ``anchors``): their
        places, the number of each among the distinct ones, the distinct ones'
        hashes (two parts), sorted, and whether each occurs more than once here."""
        values, _ = self.anchors()
        open_ = np.flatnonzero(repeated[np.searchsorted(values, self.anchor)]) if len(values) else np.zeros(0, np.int64)
        h1, h2 = self.hash1[open_], self.hash2[open_]
        order = np.lexsort((h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        return self.at[open_], number, h1[first], h2[first], np.bincount(number, minlength=len(first)) > 1

    def factors(self, found: np.ndarray) -> np.ndarray:
        """Words covered by factors: runs of found windows (positions), each to its last word."""
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, found, 1)
        np.add.at(edge, found + self.window, -1)
        return np.cumsum(edge)[:-1] > 0


def bundles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bundle, n_words, payload): compressed ids and texts of some documents each."""
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=3)
        for rows in row_chunks(batches, ["id", "text"], BUNDLE_CHARS):
            words = sum(len(words_of(r[1])) for r in rows)
            blob = pack.compress(pickle.dumps(([r[0] for r in rows], [r[1] for r in rows])))
            yield pa.RecordBatch.from_arrays([pa.array([part * (1 << 32) + seq], pa.int64()), pa.array([words], pa.int64()),
                                              pa.array([blob], pa.binary())], names=["bundle", "n_words", "payload"])
            seq += 1

    # batches of many rows are joined to bundles, those of large rows are cut
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "bundle long, n_words long, payload binary")


def unpack(payload: bytes) -> tuple[list, list]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def by_block(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys by block (stable), blocks that occur, and their borders in that order."""
    block = (mix64(keys) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    present, first = np.unique(block[order], return_index=True)
    return order, present, np.append(first, len(order))


def _sent(bundle: int, order, present, border, *parts: np.ndarray) -> pa.RecordBatch:
    blobs = [b"".join(p[order[s:e]].tobytes() for p in parts) for s, e in zip(border[:-1], border[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array(present, pa.int32()), pa.array([bundle] * len(present), pa.int64()), pa.array(blobs, pa.binary())],
        names=["block", "bundle", "entries"])


def _flags(replies: list, order: np.ndarray, present: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Answers of the blocks, in the order of the keys asked for."""
    got = {r["block"]: r["seen"] for r in replies or []}
    out = np.zeros(len(order), bool)
    for i, b in enumerate(present.tolist()):
        n = border[i + 1] - border[i]
        out[order[border[i]:border[i + 1]]] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=n).astype(bool)
    return out


def answer(sent: DataFrame, size: int) -> DataFrame:
    """For each entry of ``size`` bytes whether another bundle has sent it too, as a bitmap."""
    def run(t: pa.Table) -> pa.Table:
        blobs = t.column("entries").to_pylist()
        if size == 8:
            keys = [np.frombuffer(b, np.uint64) for b in blobs]
            flat, second = np.concatenate(keys), None
        else:  # all first parts (8 bytes), then all second parts (4 bytes) of each bundle
            n = [len(b) // 12 for b in blobs]
            keys = [np.frombuffer(b[:8 * k], np.uint64) for b, k in zip(blobs, n)]
            flat = np.concatenate(keys)
            second = np.concatenate([np.frombuffer(b[8 * k:], np.uint32) for b, k in zip(blobs, n)])
        order = np.argsort(flat, kind="stable") if second is None else np.lexsort((second, flat))
        same = flat[order][1:] == flat[order][:-1]
        if second is not None:
            same &= second[order][1:] == second[order][:-1]
        hit = np.zeros(len(flat), bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        borders = np.cumsum([0, *map(len, keys)])
        maps = [np.packbits(hit[s:e]).tobytes() for s, e in zip(borders[:-1], borders[1:])]
        return pa.table({"bundle": t.column("bundle"), "block": t.column("block"), "seen": pa.array(maps, pa.binary())})

    return sent.groupBy("block").applyInArrow(run, "bundle long, block int, seen binary")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Per document: id, n_words, n_removed, spans (word start, end) of the
    duplicate factors, and kept_text (the other words, joined by one space).

    ``window`` is the number of words from which a repeated stretch counts.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = docs.schema[id_col].dataType
    id_arrow = to_arrow_type(id_type)
    # written once: the numbering of bundles and their content must not change
    held = materialize(bundles(docs, id_col, text_col), "bundles")
    words = held.agg(F.sum("n_words")).first()[0] or 0
    anchor_blocks = max(MIN_BLOCKS, words * 8 * 2 // max(1, window - GRAM) // BLOCK_BYTES)
    window_blocks = max(MIN_BLOCKS, words * 12 // BLOCK_BYTES)

    def send_anchors(batches):
        hashes = WordHashes()
        for bundle, payload in _rows(batches, "bundle", "payload"):
            values, _ = Windows(unpack(payload)[1], window, hashes).anchors()
            yield _sent(bundle, *by_block(values, anchor_blocks), values)

    sent = "block int, bundle long, entries binary"
    anchors = materialize(_per_bundle(answer(held.mapInArrow(send_anchors, sent), 8)), "anchors_seen")

    def open_windows(own: Windows, replies):
        values, twice = own.anchors()
        return own.windows(twice | _flags(replies, *by_block(values, anchor_blocks)))

    def send_windows(batches):
        hashes = WordHashes()
        for bundle, payload, replies in _rows(batches, "bundle", "payload", "anchors"):
            _, _, h1, h2, _ = open_windows(Windows(unpack(payload)[1], window, hashes), replies)
            yield _sent(bundle, *by_block(h1, window_blocks), h1, h2)

    # answers grow with the corpus like the bundles: both sides are dealt by bundle at every size
    known = held.drop("n_words").hint("shuffle_merge").join(anchors.withColumnRenamed("replies", "anchors"), "bundle", "left")
    windows = materialize(_per_bundle(answer(known.mapInArrow(send_windows, sent), 12)), "windows_seen")

    fields = [T.StructField(id_col, id_type), T.StructField("n_words", T.LongType()),
              T.StructField("n_removed", T.LongType()),
              T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                               T.StructField("end", T.LongType())]))),
              T.StructField("kept_text", T.StringType())]

    def finish(batches):
        hashes = WordHashes()
        for payload, asked, replies in _rows(batches, "payload", "anchors", "windows"):
            ids, texts = unpack(payload)
            own = Windows(texts, window, hashes)
            at, number, h1, _, twice = open_windows(own, asked)
            found = (twice | _flags(replies, *by_block(h1, window_blocks)))[number] if len(number) else np.zeros(0, bool)
            covered = own.factors(at[found])
            removed, spans, kept = [], [], []
            for doc, s, e in zip(own.docs, own.starts.tolist(), own.ends.tolist()):
                mask = covered[s:e]
                removed.append(int(mask.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                kept.append(b" ".join(compress(doc, ~mask) if removed[-1] else doc).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_arrow), pa.array([len(d) for d in own.docs], pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.string())], names=[f.name for f in fields])

    ready = known.hint("shuffle_merge").join(windows.withColumnRenamed("replies", "windows"), "bundle", "left")
    return ready.select("payload", "anchors", "windows").mapInArrow(finish, T.StructType(fields))


def _per_bundle(answers: DataFrame) -> DataFrame:
    """A bundle's answers in one row: bits for what it has itself asked."""
    return answers.groupBy("bundle").agg(F.collect_list(F.struct("block", "seen")).alias("replies"))


def _rows(batches, *columns):
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)) for c in columns]
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in cols)
