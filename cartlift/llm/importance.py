"""Target-distribution importance resampling over hashed word n-grams.

Documents are drawn so that their hashed n-grams look like those of a target
set.  Words are the runs of letters, digits and non-ASCII characters of the
A-Z-folded text; features are all runs of 1..``max_n`` words.  A feature's
bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``.  A bucket's gain is
the log ratio of its smoothed shares in target and corpus, in thousandths; a
document's weight is the sum of its features' gains.  Gumbel noise from a
keyed hash of the id is added, and the highest scores are drawn: sampling
without replacement in proportion to exp(weight / 1000).

CRCs are computed for all distinct features of a chunk at once: features of
equal length form a two-dimensional byte array, all CRCs of which are updated
column by column; the results are scattered back to the features.  Features
longer than ``STRIPE`` bytes are cut into stripes of that length, which are
rows of one such array too; a CRC is linear, so stripes are joined by moving
the state over STRIPE zero bytes with four tables.

Two passes over the texts: the first sums bucket counts (one vector per task,
``buckets`` rows after the shuffle), the second scores.  Only the ``buckets``
gains travel to the tasks.  The draw ranks scores by range partitioning.

Defined cases: a null text has no words; an empty target or corpus gives gains
from smoothing alone; a null id is keyed as the empty text and, at equal score,
drawn before others; equal scores go to the smaller id, repeated rows to the
one read first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlift.llm.common import LOWER, UPPER, materialize, row_chunks
from cartlift.operators.ranking import global_rank

POLYNOMIAL = 0xEDB88320  # CRC-32 (fixed value)
STRIPE = 256

#: bytes to bytes: A-Z folded, everything that is no part of a word a blank
_WORD_BYTES = set(b"0123456789" + LOWER.encode()) | set(range(0x80, 0x100))
FOLD = bytes(b | 0x20 if b in UPPER.encode() else b if b in _WORD_BYTES else 0x20 for b in range(256))


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
    return t


TABLE = _byte_table()


def crc_columns(rows: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC states after the bytes of each row of a 2-d uint8 array."""
    for column in np.ascontiguousarray(rows.T):
        state = TABLE[(state ^ column) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
    return state


def _stripe_tables() -> np.ndarray:
    """What each value of each state byte becomes after STRIPE zero bytes."""
    values = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    return crc_columns(np.zeros((len(values), STRIPE), np.uint8), values).reshape(4, 256)


STRIPE_SHIFT = _stripe_tables()


def _over_stripe(state: int) -> int:
    return int(STRIPE_SHIFT[0, state & 0xFF] ^ STRIPE_SHIFT[1, state >> 8 & 0xFF]
               ^ STRIPE_SHIFT[2, state >> 16 & 0xFF] ^ STRIPE_SHIFT[3, state >> 24])


def crc32_all(features: list[bytes]) -> np.ndarray:
    """CRC-32 of every feature: one array for each length, column by column."""
    out = np.zeros(len(features), np.uint32)
    by_length: dict[int, list[int]] = {}
    long_ones: list[int] = []
    for i, f in enumerate(features):
        by_length.setdefault(len(f) % STRIPE if len(f) > STRIPE else len(f), []).append(i)
        if len(f) > STRIPE:
            long_ones.append(i)
    for n, at in by_length.items():  # long features: what stands before their first whole stripe
        rows = np.frombuffer(b"".join([features[i][:n] for i in at]), np.uint8).reshape(len(at), n)
        out[at] = crc_columns(rows, np.full(len(at), 0xFFFFFFFF, np.uint32))
    if long_ones:
        tails = b"".join([features[i][len(features[i]) % STRIPE:] for i in long_ones])
        rows = np.frombuffer(tails, np.uint8).reshape(-1, STRIPE)
        stripes = iter(crc_columns(rows, np.zeros(len(rows), np.uint32)).tolist())
        for i in long_ones:
            state = int(out[i])
            for _ in range(len(features[i]) // STRIPE):
                state = _over_stripe(state) ^ next(stripes)
            out[i] = state
    return out ^ np.uint32(0xFFFFFFFF)


class Buckets(dict):
    """feature -> bucket, remembered while fewer than ``limit`` features are held."""

    def __init__(self, buckets: int, limit: int = 300_000):
        super().__init__()
        self.buckets, self.limit = buckets, limit

    def of(self, features: list[bytes]) -> np.ndarray:
        new = set(features).difference(self)
        if len(self) + len(new) > self.limit:
            self.clear()
            new = set(features)
        if new:
            new = list(new)
            self.update(zip(new, (crc32_all(new) % np.uint32(self.buckets)).tolist()))
        return np.fromiter(map(self.__getitem__, features), np.int64, len(features))


def features_of(words: list[bytes], max_n: int) -> list[bytes]:
    """All runs of 1..max_n consecutive words, joined by one space."""
    out = list(words)
    for n in range(2, max_n + 1):
        out += map(b" ".join, zip(*(words[i:] for i in range(n))))
    return out


def _chunks(batches, columns: list[str], table: Buckets, max_n: int):
    """Per chunk: its rows, and for each row the number of words, the number of
    features and where its buckets end in the chunk's bucket array."""
    for part in row_chunks(batches, columns, 1_000_000):
        flat: list[bytes] = []
        n_words, n_features = [], []
        for row in part:
            words = row[-1].translate(FOLD).split() if row[-1] else []
            own = features_of(words, max_n) if max_n > 1 else words
            n_words.append(len(words))
            n_features.append(len(own))
            flat += own
        yield part, np.array(n_words), np.array(n_features), table.of(flat)


def bucket_counts(texts: DataFrame, text_col: str, max_n: int, buckets: int) -> np.ndarray:
    """Features of all texts per bucket; each task sends one row per bucket it met."""
    def run(batches):
        counts, table = np.zeros(buckets, np.int64), Buckets(buckets)
        for _, _, _, at in _chunks(batches, ["text"], table, max_n):
            counts += np.bincount(at, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])

    found = (texts.select(F.col(text_col).cast("string").cast("binary").alias("text"))
             .mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)  # the driver holds ``buckets`` numbers
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(((t + 1) / (T + B)) / ((s + 1) / (S + B)))) for each bucket, in doubles."""
    b = len(corpus)
    total_t, total_s = float(target.sum()) + b, float(corpus.sum()) + b
    return np.array([math.floor(1000 * math.log((float(t) + 1) * total_s / ((float(s) + 1) * total_t)))
                     for t, s in zip(target.tolist(), corpus.tolist())], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", max_n: int = 1) -> DataFrame:
    """Per document: id, n_words, n_features, weight (sum of its features' gains)."""
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = docs.schema[id_col].dataType
    id_arrow = to_arrow_type(id_type)

    def run(batches):
        table = Buckets(len(gains))
        for part, n_words, n_features, at in _chunks(batches, ["id", "text"], table, max_n):
            total = np.concatenate([[0], np.cumsum(gains[at])])
            ends = np.cumsum(n_features)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], id_arrow), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                 pa.array(total[ends] - total[ends - n_features], pa.int64())],
                names=["id", "n_words", "n_features", "weight"])

    schema = T.StructType([T.StructField("id", id_type), *[T.StructField(c, T.LongType())
                                                           for c in ("n_words", "n_features", "weight")]])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(
        run, schema).withColumnRenamed("id", id_col)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", max_n: int = 1, buckets: int = 10_000, min_words: int = 20,
             percent: int = 10, seed: int = 2024) -> DataFrame:
    """Per document: id, n_features, weight, score, rank (null: not drawn)."""
    gains = bucket_gains(bucket_counts(target, target_text_col, max_n, buckets),
                         bucket_counts(docs, text_col, max_n, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    weighed = weigh(docs, gains, id_col, text_col, max_n).withColumnRenamed(id_col, "id")
    scored = materialize(weighed.select("id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))
                         .withColumn("row", F.monotonically_increasing_id()), "scores")
    enough = scored.where(F.col("n_words") >= min_words)
    n = enough.count()
    drawn = n * percent // 100
    ranked = global_rank(enough, [("score", True), ("id", False)], tie_col="row", n=n)
    out = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(
        scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
